"""Test-quality catalogs."""

# --- Fixed values (results depend on them) ----------------------------------

# Paths that are tests, by language; case-sensitive.
TEST_PATHS = {
    "javascript": (
        r"\.test\.(js|jsx|ts|tsx)$",
        r"\.spec\.(js|jsx|ts|tsx)$",
        r"__tests__/.*\.(js|jsx|ts|tsx)$",
    ),
    "python": (r"test_\w+\.py$", r"\w+_test\.py$", r"tests/.*\.py$", r"conftest\.py$"),
    "go": (r"_test\.go$",),
    "rust": (r"tests/.*\.rs$",),
    "php": (r"Test\.php$", r"tests/.*\.php$"),
    "ruby": (r"_spec\.rb$", r"_test\.rb$", r"spec/.*\.rb$", r"test/.*\.rb$"),
    "java": (r"Test\.java$", r"Tests\.java$", r"test/.*\.java$"),
}

# Suffixes that count as source for the test ratio, by detected language.
RATIO_SUFFIXES = {
    "javascript": (".js", ".jsx", ".ts", ".tsx"),
    "typescript": (".js", ".jsx", ".ts", ".tsx"),
    "python": (".py",),
    "go": (".go",),
    "rust": (".rs",),
    "php": (".php",),
    "ruby": (".rb",),
    "java": (".java",),
    "csharp": (".cs",),
}

# A file is critical when one word is in its path and one in its text.
CRITICAL_WORDS = {
    "auth": ("login", "signup", "register", "logout", "auth", "session", "password", "token", "jwt"),
    "payments": ("payment", "checkout", "stripe", "charge", "subscribe", "billing", "invoice"),
    "data": ("create", "update", "delete", "remove", "migrate", "seed", "import", "export"),
    "api": ("api", "endpoint", "route", "controller", "handler", "middleware"),
    "security": ("sanitize", "validate", "escape", "encrypt", "decrypt", "hash", "verify"),
}

# Words in the path of a test that tell its kind.
TEST_KIND_WORDS = {
    "unit": ("test", "spec"),
    "integration": ("integration",),
    "e2e": ("e2e", "cypress", "playwright", "selenium"),
}

# Upper bounds of the coverage bands; a ratio of exactly 0 is "none".
COVERAGE_BANDS = ((20, "low"), (50, "moderate"), (80, "good"))
COVERAGE_TOP = "excellent"

# --- End of fixed values ----------------------------------------------------
