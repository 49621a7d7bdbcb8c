"""Stack catalogs: languages, frameworks, lock files, build tools, runtimes."""

# --- Fixed values (results depend on them; order is the tie-break) -----------

LANGUAGES = {
    "python": (".py", ".pyx", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "csharp": (".cs",),
    "php": (".php",),
    "ruby": (".rb",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "dart": (".dart",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "lua": (".lua",),
    "elixir": (".ex", ".exs"),
    "scala": (".scala",),
    "r": (".r",),
    "shell": (".sh", ".bash", ".zsh"),
}

# Root entries that confirm a language.
LANGUAGE_MARKERS = {
    "python": ("requirements.txt", "setup.py", "pyproject.toml", "Pipfile", "setup.cfg", "poetry.lock"),
    "javascript": ("package.json",),
    "typescript": ("tsconfig.json", "tsconfig.base.json"),
    "go": ("go.mod", "go.sum"),
    "rust": ("Cargo.toml", "Cargo.lock"),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "php": ("composer.json", "composer.lock"),
    "ruby": ("Gemfile", "Gemfile.lock"),
    "swift": ("Package.swift",),
    "kotlin": ("build.gradle.kts",),
    "dart": ("pubspec.yaml",),
    "elixir": ("mix.exs",),
    "scala": ("build.sbt",),
}

# Name endings that confirm a language at any depth.
LANGUAGE_MARKER_ENDINGS = {
    "csharp": (".csproj", ".sln", ".fsproj"),
    "ruby": (".ruby-version",),
}

# A language is sure when a marker exists or more files than this are seen.
CONFIDENT_FILE_COUNT = 5

# framework: (parts of dependency names, root config files)
FRAMEWORKS = {
    "next.js": (("next",), ("next.config.js", "next.config.ts", "next.config.mjs")),
    "react": (("react", "react-dom"), ()),
    "vue": (("vue",), ("vue.config.js", "nuxt.config.ts", "nuxt.config.js")),
    "nuxt": (("nuxt",), ("nuxt.config.ts", "nuxt.config.js")),
    "svelte": (("svelte",), ("svelte.config.js",)),
    "sveltekit": (("@sveltejs/kit",), ("svelte.config.js",)),
    "angular": (("@angular/core",), ("angular.json",)),
    "astro": (("astro",), ("astro.config.mjs", "astro.config.ts")),
    "remix": (("@remix-run/react",), ()),
    "gatsby": (("gatsby",), ("gatsby-config.js", "gatsby-config.ts")),
    "express": (("express",), ()),
    "fastify": (("fastify",), ()),
    "nestjs": (("@nestjs/core",), ("nest-cli.json",)),
    "django": (("django", "Django"), ("manage.py",)),
    "flask": (("flask", "Flask"), ()),
    "fastapi": (("fastapi",), ()),
    "spring-boot": (("spring-boot-starter",), ("application.properties", "application.yml")),
    "laravel": (("laravel/framework",), ("artisan",)),
    "rails": (("rails",), ("Rakefile", "config/routes.rb")),
    "gin": (("github.com/gin-gonic/gin",), ()),
    "fiber": (("github.com/gofiber/fiber",), ()),
    "actix-web": (("actix-web",), ()),
    "rocket": (("rocket",), ()),
    "flutter": (("flutter",), ()),
    "electron": (("electron",), ()),
    "tauri": (("tauri",), ("tauri.conf.json",)),
    "react-native": (("react-native",), ("app.json",)),
}

PACKAGE_MANAGERS = {
    "pnpm": ("pnpm-lock.yaml",),
    "yarn": ("yarn.lock",),
    "bun": ("bun.lockb",),
    "npm": ("package-lock.json",),
    "pip": ("requirements.txt",),
    "poetry": ("poetry.lock",),
    "pipenv": ("Pipfile.lock",),
    "uv": ("uv.lock",),
    "cargo": ("Cargo.lock",),
    "go-modules": ("go.sum",),
    "composer": ("composer.lock",),
    "bundler": ("Gemfile.lock",),
    "maven": ("pom.xml",),
    "gradle": ("build.gradle",),
    "pub": ("pubspec.lock",),
    "mix": ("mix.lock",),
    "nuget": ("packages.config",),
}

BUILD_TOOLS = {
    "vite": ("vite.config.js", "vite.config.ts", "vite.config.mjs"),
    "webpack": ("webpack.config.js", "webpack.config.ts"),
    "esbuild": ("esbuild.config.js",),
    "turbopack": ("turbo.json",),
    "rollup": ("rollup.config.js", "rollup.config.mjs"),
    "parcel": (".parcelrc",),
    "tsup": ("tsup.config.ts",),
    "swc": (".swcrc",),
    "babel": ("babel.config.js", ".babelrc"),
    "make": ("Makefile",),
    "cmake": ("CMakeLists.txt",),
    "docker": ("Dockerfile", "docker-compose.yml", "docker-compose.yaml"),
}

RUNTIMES = {
    "node": (".node-version", ".nvmrc"),
    "python": (".python-version", "runtime.txt"),
    "docker": ("Dockerfile",),
    "fly.io": ("fly.toml",),
    "vercel": ("vercel.json", ".vercel"),
    "netlify": ("netlify.toml",),
    "railway": ("railway.json", "railway.toml"),
    "render": ("render.yaml",),
    "heroku": ("Procfile",),
    "gcp-app-engine": ("app.yaml", "app.yml"),
    "serverless": ("serverless.yml", "serverless.yaml", "serverless.ts"),
    "terraform": ("terraform", "main.tf"),
}

TEST_RUNNERS = {
    "jest": ("jest.config.js", "jest.config.ts", "jest.config.mjs"),
    "vitest": ("vitest.config.ts", "vitest.config.js"),
    "pytest": ("pytest.ini", "pyproject.toml", "setup.cfg", "conftest.py"),
    "mocha": (".mocharc.yml", ".mocharc.json"),
    "playwright": ("playwright.config.ts", "playwright.config.js"),
    "cypress": ("cypress.config.js", "cypress.config.ts", "cypress.json"),
    "phpunit": ("phpunit.xml", "phpunit.xml.dist"),
    "rspec": (".rspec",),
    "go-test": ("go.mod",),
    "cargo-test": ("Cargo.toml",),
}

# Where a package.json may live, first one that can be read wins.
PACKAGE_JSON_PATHS = (
    "package.json", "apps/web/package.json", "frontend/package.json", "client/package.json",
)

# Regular expressions of the manifest readers.
REQUIREMENT_CUT = r"[>=<!\[\];]"
PYPROJECT_NAME = r'"([a-zA-Z0-9_-]+)(?:\[.*?\])?(?:[>=<].*?)?"'
CARGO_SECTION = r"^\[.*dependencies.*\]"
CARGO_KEY = r"^(\S+)\s*="

# --- End of fixed values ----------------------------------------------------

SUFFIX_LANGUAGE = {suffix: name for name, suffixes in LANGUAGES.items() for suffix in suffixes}

ROOT_MARKERS = tuple(dict.fromkeys(
    marker
    for table in (
        LANGUAGE_MARKERS, PACKAGE_MANAGERS, BUILD_TOOLS, RUNTIMES, TEST_RUNNERS,
        {name: configs for name, (_, configs) in FRAMEWORKS.items()},
    )
    for markers in table.values()
    for marker in markers
))
