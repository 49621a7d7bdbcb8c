"""The rule catalog: patterns, secrets, auth risks, scaling traps, test smells.

``needs`` is not part of a rule's meaning. It lists words without which the
pattern cannot match: every group must have one word in the lower-cased text.
The scan skips the regular expression where a group is missing.

``jvm`` is the pattern in a form with the same result that the JVM's engine runs as a
loop. It recurses for each round of a repeated group, and a long enough text would
overflow the stack of the executor: the repetition is made possessive where giving
rounds back cannot help, or is bounded where only existence is asked. Some are preceded by
a look at the first character, which spares most places the alternatives.

``gate`` takes the place of ``needs`` where no words can: a pattern that every text with a match
also matches, quick to search (it is used without flags for case).
"""

from __future__ import annotations

from dataclasses import dataclass

CRITICAL, WARNING, INFO = "critical", "warning", "info"


@dataclass(frozen=True)
class Rule:
    kind: str  # pattern | secret | auth | trap | test | service | critical_path
    rule_set: str
    rule_id: str
    severity: str
    pattern: str
    message: str = ""
    fix: str = ""
    extensions: tuple[str, ...] | None = None
    needs: tuple[tuple[str, ...], ...] = ()
    ignore_case: bool = True
    multiline: bool = True
    exists_only: bool = False
    jvm: str = ""
    gate: str = ""


def _pattern(rule_set, rule_id, severity, pattern, message, fix, needs=(), extensions=None, jvm="", gate=""):
    return Rule("pattern", rule_set, rule_id, severity, pattern, message, fix, extensions, needs, jvm=jvm, gate=gate)


_TS = (".ts", ".tsx")
_REACT = (".jsx", ".tsx")
_WEB = (".js", ".jsx", ".ts", ".tsx")
_PY, _GO, _PHP, _RB = (".py",), (".go",), (".php",), (".rb",)

# --- Fixed values: ids, severities, suffixes and patterns decide the results --

GENERAL = (
    _pattern("general", "hardcoded_secret", CRITICAL,
             r"""(?:api[_-]?key|password|secret|token|auth|credential)\s*[:=]\s*['"][A-Za-z0-9+/=_\-]{16,}['"]""",
             "A secret value is written in the text.", "Read it from the environment or a secret store.",
             (("key", "password", "secret", "token", "auth", "credential"), ("'", '"')),
             jvm=r"""(?=[apstc])(?:api[_-]?key|password|secret|token|auth|credential)\s*[:=]\s*['"][A-Za-z0-9+/=_\-]{16,}['"]"""),
    _pattern("general", "exposed_env_in_client", CRITICAL,
             r"(?:NEXT_PUBLIC|VITE|REACT_APP)_.*?(?:SECRET|KEY|TOKEN|PASSWORD)",
             "A variable that browsers receive carries a secret.", "Keep it on the server and proxy the call.",
             (("next_public", "vite", "react_app"), ("secret", "key", "token", "password"))),
    _pattern("general", "console_log_leftover", INFO, r"console\.log\(",
             "A console.log call was left in.", "Delete it or use a logger.", (("console.log(",),)),
    _pattern("general", "debug_leftover", WARNING,
             r"(?:debugger;|import\s+pdb|pdb\.set_trace|breakpoint\(\)|dd\(|var_dump\(|dump\(|print_r\()",
             "A debugging call was left in.", "Delete it before the commit.",
             (("debugger;", "pdb", "breakpoint()", "dd(", "dump(", "print_r("),)),
    _pattern("general", "todo_fixme", INFO, r"(?:TODO|FIXME|HACK|XXX|TEMP|TEMPORARY)\b",
             "An open-work marker.", "Do the work or file an issue for it.",
             (("todo", "fixme", "hack", "xxx", "temp"),)),
    _pattern("general", "magic_number", INFO,
             r"(?:if|while|for|return|==|!=|>=|<=|>|<)\s*(?:\d{3,})\b",
             "A bare number steers the logic.", "Give the number a name.", gate=r"[EFNRefnr=<>]\s*\d{3}",
             jvm=r"(?=[iwfr=!<>])(?:if|while|for|return|==|!=|>=|<=|>|<)\s*(?:\d{3,})\b"),
    _pattern("general", "deep_nesting", WARNING, r"(?:^\s{16,}(?:if|for|while|switch|match))",
             "Control flow nested four levels or more.", "Return early or move the inner block to a function."),
)

JAVASCRIPT = (
    _pattern("javascript", "any_type", WARNING, r":\s*any\b",
             "The any type switches checking off.", "Name the type, or use unknown.", (("any",),), _TS),
    _pattern("javascript", "ts_ignore", WARNING, r"@ts-ignore|@ts-nocheck|@ts-expect-error",
             "A type error is silenced.", "Repair the type error.",
             (("@ts-ignore", "@ts-nocheck", "@ts-expect-error"),), _TS),
    _pattern("javascript", "useeffect_no_deps", WARNING,
             r"useEffect\(\s*\(\)\s*=>\s*\{[^}]*\}\s*\)\s*;",
             "This effect runs after every render.", "Pass a dependency list.", (("useeffect(",),), _REACT),
    _pattern("javascript", "index_as_key", WARNING,
             r"\.map\([^)]*,?\s*(?:index|i|idx)\s*\)\s*=>[^}]*key\s*=\s*\{?\s*(?:index|i|idx)\s*\}?",
             "List position is used as the React key.", "Use an id of the item.", ((".map(",), ("key",)), _REACT),
    _pattern("javascript", "sync_fs", WARNING,
             r"(?:readFileSync|writeFileSync|appendFileSync|existsSync|mkdirSync)\(",
             "A blocking file call stops the event loop.", "Await the asynchronous call.",
             (("filesync(", "existssync(", "mkdirsync("),), (".js", ".ts", ".mjs", ".cjs")),
    _pattern("javascript", "eval_usage", CRITICAL, r"\beval\s*\(",
             "eval runs text as code.", "Parse the data instead.", (("eval",),), _WEB),
    _pattern("javascript", "innerhtml", WARNING, r"(?:innerHTML|dangerouslySetInnerHTML|v-html)",
             "Raw HTML is put into the page.", "Sanitise it or render text.",
             (("innerhtml", "v-html"),), _WEB + (".vue",)),
    _pattern("javascript", "fetch_no_error", WARNING,
             r"await\s+fetch\([^)]+\)\s*(?:;|\n)(?!\s*(?:\.then|\.catch|if\s*\(!|const\s+\{?\s*(?:ok|status)))",
             "The answer of fetch is not checked.", "Test response.ok and catch failures.",
             (("await",), ("fetch(",)), _WEB),
    _pattern("javascript", "no_cors_config", WARNING, r"""cors\(\s*\)""",
             "cors() without options lets every origin in.", "List the allowed origins.",
             (("cors(",),), (".js", ".ts")),
)

PYTHON = (
    _pattern("python", "bare_except", WARNING, r"except\s*:",
             "This handler also swallows interrupts.", "Name the exception class.", (("except",),), _PY),
    _pattern("python", "mutable_default", WARNING,
             r"def\s+\w+\([^)]*(?:=\s*\[\]|=\s*\{\}|=\s*set\(\))",
             "A default value is shared by all calls.", "Default to None and build it inside.",
             (("def",), ("[]", "{}", "set()")), _PY),
    _pattern("python", "star_import", WARNING, r"from\s+\S+\s+import\s+\*",
             "A star import hides where names come from.", "Import the names you use.",
             (("from",), ("import",)), _PY),
    _pattern("python", "sql_string_format", CRITICAL,
             r"""(?:execute|cursor\.execute)\s*\(\s*f?['"]+.*\{.*\}""",
             "A SQL text is built by formatting.", "Bind the values as parameters.",
             (("execute",), ("{",)), _PY),
    _pattern("python", "no_type_hints", INFO,
             r"def\s+\w+\(\s*self\s*,\s*\w+\s*(?:,\s*\w+\s*)*\)\s*:",
             "A method without type hints.", "Annotate its parameters.", (("def",), ("self",)), _PY,
             jvm=r"def\s+\w+\(\s*self\s*,\s*\w+\s*(?:,\s*\w+\s*)*+\)\s*:"),
    _pattern("python", "global_state", WARNING, r"^\s*global\s+\w+",
             "A function rebinds a global.", "Pass the value in and return it.", (("global",),), _PY),
    _pattern("python", "sync_sleep", INFO, r"time\.sleep\(",
             "The thread is put to sleep.", "Await asyncio.sleep in asynchronous code.", (("time.sleep(",),), _PY),
)

GO = (
    _pattern("go", "unchecked_error", WARNING, r"\w+,\s*_\s*:?=\s*\w+\.\w+\(",
             "An error value is thrown away.", "Handle it, or log it at least.", (("_",), ("=",)), _GO),
    _pattern("go", "goroutine_no_recover", WARNING,
             r"go\s+func\s*\([^)]*\)\s*\{(?![\s\S]*?recover)",
             "A panic in this goroutine ends the process.", "Recover in a deferred call.",
             (("go",), ("func",)), _GO),
    _pattern("go", "fmt_in_production", INFO, r"fmt\.Print",
             "Output goes through fmt.Print.", "Use a structured logger.", (("fmt.print",),), _GO),
)

PHP = (
    _pattern("php", "sql_concat", CRITICAL,
             r"""(?:\$\w+\s*\.\s*['"](?:SELECT|INSERT|UPDATE|DELETE|WHERE))|(?:query\s*\(\s*['"].*\$)""",
             "A SQL text is glued together.", "Prepare the statement and bind values.",
             (("$",), ("select", "insert", "update", "delete", "where", "query")), _PHP),
    _pattern("php", "extract_usage", WARNING, r"\bextract\s*\(",
             "extract() makes variables out of data.", "Read the array elements.", (("extract",),), _PHP),
    _pattern("php", "error_display", WARNING,
             r"(?:display_errors|error_reporting\s*\(\s*E_ALL\s*\))",
             "Errors are shown to visitors.", "Log them and show a plain page.",
             (("display_errors", "error_reporting"),), _PHP),
)

RUBY = (
    _pattern("ruby", "mass_assignment", CRITICAL, r"params\.permit!",
             "Every request field is accepted.", "Permit named fields only.", (("params.permit!",),), _RB),
    _pattern("ruby", "raw_sql", CRITICAL,
             r"""(?:execute|find_by_sql|where)\s*\(\s*['"].*#\{""",
             "A value is interpolated into SQL.", "Use placeholders.",
             (("execute", "find_by_sql", "where"), ("#{",)), _RB),
)

PERFORMANCE = (
    _pattern("performance", "n_plus_1_loop", WARNING,
             r"""(?:for\s*\([^)]*\)\s*\{[^}]*await\s+\w+\.(?:find|get|fetch|query))|(?:\.forEach\(\s*async)|(?:for\s+\w+\s+in\s+\w+:\s*\n\s+\w+\.objects\.(?:get|filter))""",
             "One database call for each loop step.", "Load the rows in one call before the loop.",
             (("await", ".foreach(", ".objects."),)),
    _pattern("performance", "no_pagination", WARNING,
             r"""(?:\.find\(\s*\{\s*\}\s*\))|(?:\.findMany\(\s*\))|(?:\.objects\.all\(\))|(?:SELECT\s+\*\s+FROM\s+\w+\s*;?\s*$)""",
             "A query without a limit.", "Page through the rows.",
             ((".find(", ".findmany(", ".objects.all()", "select"),)),
    _pattern("performance", "load_all_in_memory", WARNING,
             r"""(?:JSON\.parse\(\s*(?:fs\.)?readFileSync)|(?:\.read\(\)\.split\()|(?:pd\.read_csv\([^)]*\)\s*(?!.*chunksize))""",
             "A whole file is held in memory.", "Stream it in pieces.",
             (("json.parse(", ".read().split(", "pd.read_csv("),)),
    _pattern("performance", "unbounded_loop", INFO, r"while\s*\(\s*true\s*\)|while\s+True\s*:",
             "A loop without an end condition.", "Bound the number of rounds.", (("while",), ("true",))),
)

DATABASE = (
    _pattern("database", "sqlite_in_production", WARNING,
             r"""(?:sqlite3|better-sqlite3|django\.db\.backends\.sqlite3|DATABASE_URL.*?sqlite|\.sqlite3?|file:.*\.db)""",
             "SQLite takes one writer at a time.", "Use a server database in production.",
             (("sqlite", "file:"),)),
    _pattern("database", "no_connection_pool", WARNING,
             r"""(?:mysql\.createConnection|pg\.Client\(|psycopg2\.connect\()""",
             "Connections are opened one by one.", "Take them from a pool.",
             (("mysql.createconnection", "pg.client(", "psycopg2.connect("),)),
    _pattern("database", "raw_sql_no_param", CRITICAL,
             r"""(?:\.query|\.execute)\s*\(\s*(?:`|f?['"]).*?(?:\$\{|\{|%s|%d|\+\s*\w+)""",
             "Values are put into a SQL text.", "Bind the values as parameters.", ((".query", ".execute"),)),
)


def _secret(rule_id, pattern, *words):
    return Rule("secret", "secret", rule_id, CRITICAL, pattern, f"{rule_id} in the text.",
                "Revoke it, then keep the new one out of the repository.",
                needs=(words,), ignore_case=False, multiline=False)


SECRETS = (
    _secret("AWS Access Key ID", r"""(?:AKIA[0-9A-Z]{16})""", "AKIA"),
    _secret("OpenAI / Stripe Secret Key", r"""(?:sk-[a-zA-Z0-9]{20,})""", "sk-"),
    _secret("GitHub Personal Access Token", r"""(?:ghp_[A-Za-z0-9]{36})""", "ghp_"),
    _secret("GitHub OAuth Token", r"""(?:gho_[A-Za-z0-9]{36})""", "gho_"),
    _secret("GitLab Personal Access Token", r"""(?:glpat-[A-Za-z0-9\-]{20,})""", "glpat-"),
    _secret("Slack Bot Token", r"""(?:xoxb-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{24})""", "xoxb-"),
    _secret("Slack User Token", r"""(?:xoxp-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{24})""", "xoxp-"),
    _secret("SendGrid API Key", r"""(?:SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43})""", "SG."),
    _secret("Square Access Token", r"""(?:sq0csp-[A-Za-z0-9_\-]{43})""", "sq0csp-"),
    _secret("Twilio Account SID", r"""(?:AC[a-f0-9]{32})""", "AC"),
    _secret("Mailgun API Key", r"""(?:key-[A-Za-z0-9]{32})""", "key-"),
    _secret("Stripe Restricted Key", r"""(?:rk_live_[A-Za-z0-9]{24,})""", "rk_live_"),
    _secret("Stripe Publishable Live Key", r"""(?:pk_live_[A-Za-z0-9]{24,})""", "pk_live_"),
    _secret("Stripe Webhook Secret", r"""(?:whsec_[A-Za-z0-9]{32,})""", "whsec_"),
    _secret("Private Key in source", r"""(?:-----BEGIN (?:RSA |EC )?PRIVATE KEY-----)""", "PRIVATE KEY-----"),
)


def _auth(rule_id, pattern, message, fix, needs):
    return Rule("auth", "auth", rule_id, WARNING, pattern, message, fix, needs=needs)


AUTH = (
    _auth("jwt_no_expiry", r"""jwt\.sign\([^)]*(?!expiresIn)""",
          "A token is signed; check that it ends.", "Set an expiry time.", (("jwt.sign(",),)),
    _auth("password_plain_compare", r"""(?:password\s*===?\s*\w+|if\s*\(\s*\w+\.password\s*===?)""",
          "A password is compared as plain text.", "Compare with the hashing library.", (("password",), ("==",))),
    _auth("cors_wildcard", r"""(?:origin:\s*['"]?\*['"]?|Access-Control-Allow-Origin.*\*)""",
          "Every origin may call.", "List the allowed origins.",
          (("origin:", "access-control-allow-origin"), ("*",))),
    _auth("no_rate_limit", r"""(?:app\.(?:post|put|patch|delete)\s*\(\s*['"]\/(?:login|auth|signup|register|api))""",
          "This endpoint has no visible rate limit.", "Put a limiter in front.",
          (("app.",), ("/login", "/auth", "/signup", "/register", "/api"))),
    _auth("cookie_no_secure", r"""(?:cookie|setCookie|set-cookie)(?!.*(?:secure|httpOnly|HttpOnly))""",
          "A cookie without protective flags.", "Set secure, httpOnly and sameSite.", (("cookie",),)),
)


def _trap(rule_id, severity, pattern, message, fix, needs, jvm=""):
    return Rule("trap", "trap", rule_id, severity, pattern, message, fix, needs=needs, exists_only=True, jvm=jvm)


TRAPS = (
    _trap("sqlite_production", WARNING,
          r"""(?:sqlite3|better-sqlite3|django\.db\.backends\.sqlite3|knex.*sqlite|DATABASE_URL.*sqlite)""",
          "SQLite serves one writer only.", "Use a server database.", (("sqlite",),)),
    _trap("in_memory_session", WARNING,
          r"""(?:express-session.*?(?:MemoryStore|store:\s*undefined)|session\s*=\s*\{\})""",
          "Sessions live in one process.", "Keep them in a shared store.", (("session",),)),
    _trap("local_file_upload", WARNING,
          r"""(?:multer\(\s*\{[^}]*dest:\s*['"]\./|upload_to\s*=\s*['"]uploads|fs\.writeFile.*uploads)""",
          "Uploads stay on one disk.", "Put them in object storage.",
          (("multer(", "upload_to", "fs.writefile"),)),
    _trap("no_queue_for_heavy", INFO,
          r"""(?:(?:await|\.then).*?(?:sendEmail|processImage|generatePDF|transcode|resize))""",
          "Heavy work runs inside the request.", "Hand it to a queue.",
          (("await", ".then"), ("sendemail", "processimage", "generatepdf", "transcode", "resize"))),
    _trap("no_cache_layer", INFO,
          r"""(?:(?:app\.get|router\.get)\s*\([^)]*\)\s*(?:.*?(?:query|find|fetch)){2,})""",
          "A read endpoint asks the database twice or more.", "Cache the answer.",
          (("app.get", "router.get"), ("query", "find", "fetch")),
          jvm=r"(?:(?:app\.get|router\.get)\s*\([^)]*\)\s*(?:.*?(?:query|find|fetch)){2})"),
)


def _test(rule_id, severity, pattern, message, fix, needs, jvm=""):
    return Rule("test", "test", rule_id, severity, pattern, message, fix, needs=needs, ignore_case=False, jvm=jvm)


TEST_SMELLS = (
    _test("snapshot_overuse", INFO, r"toMatchSnapshot\(\)|toMatchInlineSnapshot\(",
          "A snapshot stands in for a check.", "Assert what the code does.",
          (("toMatchSnapshot()", "toMatchInlineSnapshot("),)),
    _test("no_assertion", WARNING,
          r"it\s*\(\s*['\"].*['\"].*\{[^}]*\}\s*\)(?!.*(?:expect|assert|should))",
          "A test that checks nothing.", "Assert the outcome.", (("it",),)),
    _test("test_implementation", INFO, r"(?:toHaveBeenCalledWith|\.mock\.|jest\.fn\(\)|vi\.fn\(\)){3,}",
          "Mocks outweigh the behaviour.", "Check results instead of calls.",
          (("toHaveBeenCalledWith", ".mock.", "jest.fn()", "vi.fn()"),),
          jvm=r"(?:toHaveBeenCalledWith|\.mock\.|jest\.fn\(\)|vi\.fn\(\)){3,}+"),
    _test("sleep_in_test", WARNING, r"(?:setTimeout|sleep|wait)\s*\(\s*\d{3,}",
          "The test waits a fixed time.", "Wait for the event.", (("setTimeout", "sleep", "wait"),)),
    _test("skip_markers", INFO, r"(?:\.skip\s*\(|xit\s*\(|xdescribe\s*\(|@pytest\.mark\.skip|@unittest\.skip)",
          "A test is switched off.", "Repair it or delete it.",
          ((".skip", "xit", "xdescribe", "@pytest.mark.skip", "@unittest.skip"),)),
)

# --- End of fixed values ----------------------------------------------------

# Rule sets every file gets, and rule sets a detected language adds.
ALWAYS_SETS = ("general", "performance", "database")
SET_CATEGORIES = {
    "javascript": ("javascript", "typescript"),
    "python": ("python",),
    "go": ("go",),
    "php": ("php",),
    "ruby": ("ruby",),
}

RULE_SETS = {
    "general": GENERAL,
    "performance": PERFORMANCE,
    "database": DATABASE,
    "javascript": JAVASCRIPT,
    "python": PYTHON,
    "go": GO,
    "php": PHP,
    "ruby": RUBY,
}

PATTERN_RULES = tuple(rule for rules in RULE_SETS.values() for rule in rules)
