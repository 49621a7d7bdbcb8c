"""Path catalogs: which directories are pruned and which suffixes each layer reads."""

# --- Fixed values (results depend on them) ---------------------------------

# Directories the rule scan never enters.
PATTERN_SKIP_DIRS = (
    "node_modules", ".next", "dist", ".git", ".pnpm", "__pycache__", ".turbo",
    "build", "coverage", "target", "vendor", ".venv", "venv", "env", ".tox",
    ".mypy_cache", ".pytest_cache", "bin", "obj", ".gradle", ".idea", ".vs",
    ".vscode",
)

# Directories that do not count for stack detection: the same and ".env".
STACK_SKIP_DIRS = PATTERN_SKIP_DIRS + (".env",)

# Directories that security, cost and test layers never enter.
CORE_SKIP_DIRS = (
    "node_modules", ".next", "dist", ".git", ".pnpm", "__pycache__", ".turbo",
    "build", "coverage", "target", "vendor", ".venv", "venv",
)

IMAGE_SKIP_DIRS = (
    "node_modules", ".git", "dist", "build", ".next", "vendor", "__pycache__",
)

REACT_SKIP_DIRS = ("node_modules", ".next", "dist")

# Suffixes read by the rule scan.
SOURCE_SUFFIXES = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".pyx", ".go", ".rs",
    ".java", ".cs", ".php", ".rb", ".swift", ".kt", ".vue", ".svelte",
)

# Suffixes read by the secret scan; names that start with ".env" are read too.
SECRET_SUFFIXES = (
    ".js", ".jsx", ".ts", ".tsx", ".py", ".go", ".rs", ".java", ".cs", ".php",
    ".rb", ".yaml", ".yml", ".json", ".toml", ".env", ".cfg", ".conf", ".ini",
    ".properties",
)

# Suffixes read by the auth, service and scaling-trap scans.
CODE_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".py", ".go", ".php", ".rb")

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".svg")

LARGE_IMAGE_BYTES = 500 * 1024

# Root files whose text is searched for service keys, in reading order.
ENV_FILES = (".env", ".env.local", ".env.production", ".env.example")

# A file or directory whose name ends with one of these is sensitive.
SENSITIVE_ENDINGS = (
    ".env", ".env.local", ".env.production", "credentials.json",
    "service-account.json", "serviceAccountKey.json", "id_rsa", "id_ed25519",
    ".pem", ".key", ".p12", ".pfx",
)

# Files the rule scan reads per repository, in depth-first name order.
MAX_FILES = 500

# --- End of fixed values ----------------------------------------------------
