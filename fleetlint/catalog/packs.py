"""Rule packs, one for each language; a pack may extend another.

A pack is data: ``{"extends": name or None, "rules": [Rule, ...]}``. Rules that
equal one of the scan rules are taken from there, so that a pattern is stated once.
"""

from __future__ import annotations

from dataclasses import replace

from fleetlint.catalog.rules import (
    CRITICAL, GENERAL, GO, INFO, JAVASCRIPT, PERFORMANCE, PHP, PYTHON, RUBY, WARNING, Rule,
)

_BY_ID = {(r.rule_set, r.rule_id): r for r in GENERAL + JAVASCRIPT + PYTHON + GO + PHP + RUBY + PERFORMANCE}


def _same(pack, rule_set, rule_id, new_id=None, extensions=None):
    rule = _BY_ID[(rule_set, rule_id)]
    return replace(rule, rule_set=pack, rule_id=new_id or rule_id, extensions=extensions or rule.extensions)


def _rule(pack, rule_id, severity, pattern, message, fix, needs, *extensions):
    return Rule("pattern", pack, rule_id, severity, pattern, message, fix, extensions, needs)


# --- Fixed values: ids, severities, suffixes and patterns decide the results --

CSHARP_PACK = (
    _rule("csharp", "catch_exception", WARNING, r"catch\s*\(\s*Exception\b",
          "The handler takes every exception.", "Catch what you can handle.", (("catch",), ("exception",)), ".cs"),
    _rule("csharp", "empty_catch", WARNING, r"catch\s*(?:\([^)]*\))?\s*\{\s*\}",
          "An error vanishes here.", "Log it at least.", (("catch",),), ".cs"),
    _rule("csharp", "console_write", INFO, r"Console\.Write",
          "Output goes to the console.", "Use a logger.", (("console.write",),), ".cs"),
    _rule("csharp", "sql_concat", CRITICAL, r'"SELECT.*"\s*\+',
          "A SQL text is glued together.", "Bind the values.", (('"select',),), ".cs"),
    _rule("csharp", "async_void", WARNING, r"async\s+void\s+",
          "Nobody can await this method.", "Return a Task.", (("async",), ("void",)), ".cs"),
)

GENERAL_PACK = (
    _same("general", "general", "hardcoded_secret"),
    _same("general", "general", "exposed_env_in_client"),
    _same("general", "general", "debug_leftover"),
    _same("general", "general", "todo_fixme"),
    _same("general", "general", "magic_number"),
    _same("general", "general", "deep_nesting"),
)

GO_PACK = (
    _same("go", "go", "unchecked_error"),
    _rule("go", "goroutine_no_recover", WARNING, r"go\s+func\s*\([^)]*\)\s*\{",
          "Check that this goroutine recovers.", "Recover in a deferred call.", (("go",), ("func",)), ".go"),
    _same("go", "go", "fmt_in_production"),
    _rule("go", "init_function", INFO, r"func\s+init\(\)",
          "init() runs out of sight.", "Initialise where it is needed.", (("func",), ("init()",)), ".go"),
    _rule("go", "panic_in_library", WARNING, r"\bpanic\(",
          "Callers cannot handle a panic.", "Return an error.", (("panic(",),), ".go"),
)

JAVA_PACK = (
    _rule("java", "catch_exception", WARNING, r"catch\s*\(\s*Exception\s+",
          "The handler takes every exception.", "Catch what you can handle.", (("catch",), ("exception",)), ".java"),
    _rule("java", "system_out", INFO, r"System\.out\.print",
          "Output goes to the console.", "Use a logger.", (("system.out.print",),), ".java"),
    _rule("java", "string_concat_loop", INFO, r"for\s*\([^)]*\)\s*\{[^}]*\+=",
          "A string grows inside a loop.", "Use a builder.", (("for",), ("+=",)), ".java"),
    _rule("java", "sql_concat", CRITICAL, r'"SELECT.*"\s*\+',
          "A SQL text is glued together.", "Bind the values.", (('"select',),), ".java"),
    _rule("java", "empty_catch", WARNING, r"catch\s*\([^)]+\)\s*\{\s*\}",
          "An error vanishes here.", "Log it at least.", (("catch",),), ".java"),
)

JAVASCRIPT_PACK = (
    _same("javascript", "javascript", "any_type"),
    _same("javascript", "javascript", "ts_ignore"),
    _same("javascript", "javascript", "useeffect_no_deps"),
    _same("javascript", "javascript", "index_as_key"),
    _same("javascript", "javascript", "sync_fs"),
    _same("javascript", "javascript", "eval_usage"),
    _same("javascript", "javascript", "innerhtml"),
    _rule("javascript", "fetch_no_error", WARNING, r"await\s+fetch\([^)]+\)\s*(?:;|\n)",
          "Check that this answer is tested.", "Test response.ok and catch failures.",
          (("await",), ("fetch(",)), ".js", ".jsx", ".ts", ".tsx"),
    _same("javascript", "javascript", "no_cors_config", "cors_wildcard"),
    _same("javascript", "general", "console_log_leftover", "console_log", (".js", ".jsx", ".ts", ".tsx")),
)

PHP_PACK = (
    _same("php", "php", "sql_concat"),
    _same("php", "php", "extract_usage"),
    _same("php", "php", "error_display"),
    _rule("php", "md5_password", CRITICAL, r"md5\s*\(\s*\$.*(?:pass|pwd)",
          "md5 does not protect passwords.", "Use password_hash().", (("md5",), ("pass", "pwd")), ".php"),
    _same("php", "javascript", "eval_usage", extensions=(".php",)),
    _rule("php", "serialize_user_data", CRITICAL, r"unserialize\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)",
          "Request data becomes objects.", "Decode JSON instead.", (("unserialize",),), ".php"),
)

PYTHON_PACK = (
    _same("python", "python", "bare_except"),
    _same("python", "python", "mutable_default"),
    _same("python", "python", "star_import"),
    _same("python", "python", "sql_string_format"),
    _same("python", "python", "global_state"),
    _same("python", "python", "sync_sleep"),
    _same("python", "python", "no_type_hints"),
    _rule("python", "assert_in_production", INFO, r"^\s*assert\s+",
          "Optimised runs drop assert.", "Raise an exception.", (("assert",),), ".py"),
)

RUBY_PACK = (
    _same("ruby", "ruby", "mass_assignment"),
    _same("ruby", "ruby", "raw_sql"),
    _same("ruby", "javascript", "eval_usage", extensions=(".rb",)),
    _rule("ruby", "puts_in_production", INFO, r"\bputs\s+",
          "Output goes through puts.", "Use the logger.", (("puts",),), ".rb"),
    _rule("ruby", "rescue_exception", WARNING, r"rescue\s+Exception\b",
          "Signals are rescued too.", "Rescue StandardError.", (("rescue",), ("exception",)), ".rb"),
)

RUST_PACK = (
    _rule("rust", "unwrap_usage", WARNING, r"\.unwrap\(\)",
          "A missing value panics here.", "Propagate it with ?.", ((".unwrap()",),), ".rs"),
    _rule("rust", "expect_no_message", INFO, r'\.expect\(\s*""\s*\)',
          "The panic will say nothing.", "Say what was expected.", ((".expect(",),), ".rs"),
    _rule("rust", "clone_overuse", INFO, r"\.clone\(\)",
          "A copy that may be needless.", "Borrow where you can.", ((".clone()",),), ".rs"),
    _rule("rust", "unsafe_block", WARNING, r"unsafe\s*\{",
          "An unsafe block.", "Keep it small and say why it holds.", (("unsafe",),), ".rs"),
    _rule("rust", "todo_macro", WARNING, r"todo!\(",
          "Reaching this panics.", "Write the missing part.", (("todo!(",),), ".rs"),
)

TYPESCRIPT_PACK = (
    _same("typescript", "javascript", "any_type"),
    _same("typescript", "javascript", "ts_ignore"),
    _rule("typescript", "non_null_assertion", INFO, r"\w+!\.",
          "The ! hides a possible null.", "Use ?. or test for null.", (("!.",),), ".ts", ".tsx"),
    _rule("typescript", "type_assertion_as_any", WARNING, r"as\s+any\b",
          "A cast to any switches checking off.", "Cast to the real type.", (("as",), ("any",)), ".ts", ".tsx"),
)

# Off by default: checks that only the written advice names.
ADVICE_PACK = (
    _rule("checklist", "pickle_loads", WARNING, r"pickle\.loads?\(",
          "Unpickling runs code from the data.", "Use a data-only format.", (("pickle.load",),), ".py"),
    _rule("checklist", "unserialize", WARNING, r"\bunserialize\s*\(",
          "Data becomes objects.", "Decode JSON instead.", (("unserialize",),), ".php"),
    _rule("checklist", "unescaped_template", WARNING, r"\{!!\s*\$\w+",
          "A template prints raw HTML.", "Use the escaping form.", (("{!!",),), ".php"),
    _rule("checklist", "debug_enabled", WARNING, r"\bDEBUG\s*=\s*true\b",
          "Debug mode is switched on.", "Switch it off in production.", (("debug",), ("true",)),
          ".py", ".js", ".ts", ".php", ".rb"),
)

# --- End of fixed values ----------------------------------------------------

PACKS = {
    "csharp": {"extends": None, "rules": CSHARP_PACK},
    "general": {"extends": None, "rules": GENERAL_PACK},
    "go": {"extends": None, "rules": GO_PACK},
    "java": {"extends": None, "rules": JAVA_PACK},
    "javascript": {"extends": None, "rules": JAVASCRIPT_PACK},
    "php": {"extends": None, "rules": PHP_PACK},
    "python": {"extends": None, "rules": PYTHON_PACK},
    "ruby": {"extends": None, "rules": RUBY_PACK},
    "rust": {"extends": None, "rules": RUST_PACK},
    "typescript": {"extends": "javascript", "rules": TYPESCRIPT_PACK},
    "checklist": {"extends": None, "rules": ADVICE_PACK},
}
