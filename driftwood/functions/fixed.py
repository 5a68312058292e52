"""Names, lists, patterns and constants that results depend on. No logic here."""

# fmt: off
CLASSES = "feat fix docs style refactor perf test build ci chore revert".split()
CATEGORIES = "source test docs ci build lock config style i18n asset snapshot generated changelog license data template script schema version".split()
TYPE_ALIASES = {"tests": "test", "feature": "feat", "bugfix": "fix", "doc": "docs", "bug": "fix"}
CORPUS_ALIASES = {"refac": "refactor", "perfs": "perf"}
SCIPY_PREFIXES = {"ENH": "feat", "FEA": "feat", "FEAT": "feat", "BUG": "fix", "FIX": "fix", "DOC": "docs", "DOCS": "docs", "TST": "test", "TEST": "test", "MAINT": "chore", "MNT": "chore", "CLN": "refactor", "REF": "refactor", "PERF": "perf", "CI": "ci", "BLD": "build", "STY": "style", "DEP": "build", "DEPS": "build", "TYP": "refactor"}
BOTS = r"(?i)\[bot\]|dependabot|renovate|github-actions|semantic-release|greenkeeper|allcontributors|snyk-bot|pre-commit-ci|copybara|gcf-owl-bot|release-please|weblate|transifex"

HASH_BITS = 20
#: The structural slot that tells whether a message is among the features.
DENSE_MESSAGE = 58
FNV_START, FNV_STEP = 140069, 435  # of 64-bit FNV-1a, the low 20 bits and the multiplier's
MAX_FILES, MAX_LINES, MAX_LINE, MAX_HUNKS, MAX_TOKENS, LONG_LINE, MAX_PATHS = 200, 400, 1000, 64, 40, 400, 50
WINDOW, MIN_ENTRIES, NEIGHBOURS = 1000, 20, 15
KNN_SMOOTH, CONF_DIAGONAL, CONF_SMOOTH, FILE_SMOOTH = 0.3, 2.0, 0.2, 0.05
PRIOR_POWER, ASK_BELOW, DISPUTE_FROM, META_EPSILON = 0.7, 0.55, 0.75, 1e-6

TEST_WORDS = ["describe(", "it(", "test(", "expect(", "assert", "should", "func test", "def test_", "@test", "#[test]", "t.run(", "mock", "fixture", "tomatch", "tobe", "toequal", "spec", "stub", "snapshot", "beforeeach", "aftereach", "@pytest"]
ERROR_WORDS = ["error", "err ", "err.", "catch", "throw", "except", "panic", "raise ", "rescue", "unwrap", "?;", "try", "fail", "invalid"]
NULL_WORDS = ["!= nil", "== nil", "null", "undefined", "none", "?.", "??", "is_some", "optional", "isset(", "empty(", "if (!", "if !", "if not ", "|| "]
LOG_WORDS = ["console.", "log.", "logger", "println", "print(", "printf", "debug", "trace", "warn", "logging", "tracing::"]
TYPE_WORDS = ["interface ", "type ", ": string", ": number", "readonly", "typedef", "@param", "@return", "-> ", "generic", "<t>", "typing", "struct ", "enum ", "class ", "impl "]

LANGUAGES = {
    "js": "js mjs cjs jsx", "ts": "ts mts cts tsx", "sfc": "vue svelte astro", "py": "py pyi pyx pxd ipynb", "go": "go", "rust": "rs", "jvm": "java kt kts scala groovy",
    "ruby": "rb erb", "php": "php", "c": "c h cc cpp cxx hpp hh hxx m mm cu cuh", "dotnet": "cs fs vb", "swift": "swift", "dart": "dart", "beam": "ex exs erl heex eex",
    "fp": "hs ml mli elm purs clj cljs rkt scm lisp el fnl", "lua": "lua vim", "shell": "sh bash zsh fish ps1 bat cmd nu", "css": "css scss sass less styl", "html": "html htm xhtml",
    "doc": "md mdx rst adoc txt", "config": "json json5 jsonc yaml yml toml ini cfg conf xml properties hcl tf tfvars cue nix", "schema": "sql proto graphql gql prisma",
    "other": "zig nim v d cr jl r pl pm sol gd tcl f90 asm s",
}
CODE_EXT = "go rs py js ts tsx jsx mjs cjs mts cts java kt kts scala rb php c h cc cpp cxx hpp hh hxx cs fs swift m mm dart ex exs erl hs ml mli clj cljs lua pl pm r jl zig nim v sv vhd vue svelte astro elm purs re res groovy gradle sol move cu cuh cl glsl hlsl wgsl metal vert frag asm s d pas f90 f for tf cr gd gdscript rkt scm lisp el vim fnl tcl ps1 sh bash zsh fish pyx pxd pyi ipynb sql proto graphql prisma css scss less html".split()

SCOPE_CONTAINERS = "packages apps libs lib crates modules services plugins internal cmd pkg src components projects extensions integrations providers adapters connectors workspaces app api core features domain".split()
SCOPE_WEAK = "src components core app api".split()
SCOPE_SKIPPED = "test tests __tests__ spec docs doc src lib internal pkg cmd main java kotlin resources utils util common shared index js ts go python scripts config assets static public vendor node_modules dist build types helpers".split()

# name, code, type of each emoji, in table order
EMOJI = [
    ("🎨", "art", "style"), ("⚡️", "zap", "perf"), ("🔥", "fire", "refactor"), ("🐛", "bug", "fix"), ("🚑️", "ambulance", "fix"), ("✨", "sparkles", "feat"), ("📝", "memo", "docs"), ("🚀", "rocket", "chore"),
    ("💄", "lipstick", "style"), ("🎉", "tada", "feat"), ("✅", "white_check_mark", "test"), ("🔒️", "lock", "fix"), ("🔐", "closed_lock_with_key", "chore"), ("🔖", "bookmark", "chore"), ("🚨", "rotating_light", "style"),
    ("🚧", "construction", ""), ("💚", "green_heart", "ci"), ("⬇️", "arrow_down", "build"), ("⬆️", "arrow_up", "build"), ("📌", "pushpin", "build"), ("👷", "construction_worker", "ci"), ("📈", "chart_with_upwards_trend", "feat"),
    ("♻️", "recycle", "refactor"), ("➕", "heavy_plus_sign", "build"), ("➖", "heavy_minus_sign", "build"), ("🔧", "wrench", "chore"), ("🔨", "hammer", "chore"), ("🌐", "globe_with_meridians", "feat"), ("✏️", "pencil2", "docs"),
    ("💩", "poop", ""), ("⏪️", "rewind", "revert"), ("🔀", "twisted_rightwards_arrows", ""), ("📦️", "package", "build"), ("👽️", "alien", "fix"), ("🚚", "truck", "refactor"), ("📄", "page_facing_up", "docs"), ("💥", "boom", "feat"),
    ("🍱", "bento", "chore"), ("♿️", "wheelchair", "feat"), ("💡", "bulb", "docs"), ("🍻", "beers", ""), ("💬", "speech_balloon", ""), ("🗃️", "card_file_box", ""), ("🔊", "loud_sound", ""), ("🔇", "mute", ""), ("👥", "busts_in_silhouette", "docs"),
    ("🚸", "children_crossing", "feat"), ("🏗️", "building_construction", "refactor"), ("📱", "iphone", "feat"), ("🤡", "clown_face", "test"), ("🥚", "egg", "feat"), ("🙈", "see_no_evil", "chore"), ("📸", "camera_flash", "test"), ("⚗️", "alembic", ""),
    ("🔍️", "mag", "feat"), ("🏷️", "label", "refactor"), ("🌱", "seedling", "chore"), ("🚩", "triangular_flag_on_post", "feat"), ("🥅", "goal_net", "fix"), ("💫", "dizzy", "feat"), ("🗑️", "wastebasket", "refactor"), ("🛂", "passport_control", "feat"),
    ("🩹", "adhesive_bandage", "fix"), ("🧐", "monocle_face", ""), ("⚰️", "coffin", "refactor"), ("🧪", "test_tube", "test"), ("👔", "necktie", "feat"), ("🩺", "stethoscope", "feat"), ("🧱", "bricks", "chore"), ("🧑‍💻", "technologist", "chore"),
    ("💸", "money_with_wings", "chore"), ("🧵", "thread", ""), ("🦺", "safety_vest", "feat"), ("✈️", "airplane", "feat"), ("🦖", "t-rex", ""),
]
EMOJI_OF_TYPE = {"feat": "sparkles", "fix": "bug", "docs": "memo", "style": "art", "refactor": "recycle", "perf": "zap", "test": "white_check_mark", "build": "package", "ci": "construction_worker", "chore": "wrench", "revert": "rewind"}
STRUCTURAL_EMOJI = "bookmark heavy_plus_sign heavy_minus_sign arrow_up arrow_down pushpin see_no_evil page_facing_up busts_in_silhouette truck bento camera_flash label globe_with_meridians card_file_box green_heart".split()
VARIATION = "️"

MESSAGE = {
    "wip": r"^\s*\[?wip\b", "typo": r"\btypos?\b", "hotfix": r"\bhot-?fix\b", "ci_fix": r"\b(fix\w*|broken|fail\w*|green|flaky|unbreak)\b", "a11y": r"\b(a11y|accessib\w*|aria|screen ?readers?)\b",
    "i18n": r"\b(i18n|l10n|translat\w*|locali[sz]\w*)\b", "analytics": r"\b(analytics|tracking|telemetry)\b", "flag": r"\bfeature[ -]?(flags?|toggles?)\b", "animation": r"\b(animat\w*|transitions?)\b",
    "responsive": r"\b(responsive|mobile layout|breakpoints?)\b", "seo": r"\bseo\b", "authz": r"\b(authori[sz]\w*|permissions?|rbac|acl|roles?)\b", "validation": r"\bvalidat\w*\b", "deprecate": r"\bdeprecat\w*\b",
    "dead_code": r"\b(dead code|unused)\b", "architecture": r"\barchitect\w*\b", "lint": r"\b(lint\w*|warnings?|eslint|clippy|golangci|rubocop|flake8|pylint|staticcheck|go vet)\b",
    "release": r"^\s*(release|bump (the )?version|prepare (the )?release|v?\d+\.\d+\.\d+)", "failing": r"\b(failing|red) tests?\b", "bump": r"^\s*(bump|upgrade|update)\b", "downgrade": r"^\s*(downgrade|rollback|roll back)\b", "pin": r"^\s*pin\b",
}
LOG_LINE = r"(?i)(console\.(log|debug|info|warn|error|trace)\(|\b(log|logger|logging|logrus|zap|slog|tracing)\w*[.:]{1,2}(debug|info|infof|warn|warnf|warning|error|errorf|trace|fatal|print\w*)\b|fmt\.Print|println!|eprintln!|dbg!|\bprint\(|System\.(out|err)\.print|error_log\(|var_dump\(|\bdd\(|\bdump\(|\bconsole\.dir\()"
COMMENT_LINE = "^\\s*(//|#|/\\*|\\*|--|;|<!--|-->|\"\"\"|''')"
LICENSE_NAMES = "license license.md license.txt licence licence.md licence.txt copying copying.md copying.txt unlicense notice notice.md notice.txt license-mit license-apache".split()
CONTRIBUTOR_NAMES = "authors authors.md authors.txt contributors contributors.md contributors.txt maintainers maintainers.md .mailmap humans.txt .all-contributorsrc".split()

# the parser of each manifest: pattern (name, version), names that are no dependencies
DEPENDENCY_LINES = {
    "json": r'^\s*"([^"]+)"\s*:\s*"([^"]*)"\s*,?\s*$', "go": r"^\s*(?:require )?([A-Za-z0-9][^\s]*[./][^\s]*)\s+(v\d[^\s]*)", "toml": r'^\s*([A-Za-z0-9_.\-]+)\s*=\s*(?:"([^"]*)"|\{[^}]*version\s*=\s*"([^"]*)")',
    "pylist": r'^\s*"([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([<>=!~^][^"]*)?"\s*,?\s*$', "requirements": r"^\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(?:([<>=!~]{1,2})\s*([^\s;#]+))?", "gem": r"""^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""",
    "yaml": r"^\s{2,}([A-Za-z0-9_\-]+):\s*([\^~>=<]*\d[^\s#]*|any)?\s*$", "mix": r'\{\s*:([a-z0-9_]+)\s*,\s*"([^"]*)"', "gradle": r"""['"]([^'":\s]+:[^'":\s]+):([^'"\s]+)['"]""",
    "swift": r'\.package\(.*?url:\s*"([^"]+)".*?(?:from:|exact:|branch:|revision:|\.upToNextMajor\(from:|\.upToNextMinor\(from:)\s*"([^"]+)"', "uses": r"^\s*-?\s*uses:\s*([^@\s]+)@(\S+)", "docker": r"^\s*FROM\s+(?:--platform=\S+\s+)?([^:\s@]+)[:@](\S+)",
}
NO_DEPENDENCY = {
    "json": "name version main module types description license author homepage type packagemanager node npm pnpm yarn bun".split(),
    "toml": "name version edition description license readme repository homepage documentation rust-version requires-python python python_version build-backend authors keywords categories publish exclude include default-run".split(),
    "yaml": "sdk flutter version name description environment path git ref url".split(),
}
GO_DIRECTIVES = r"^\s*(//|go |toolchain |module |replace |exclude )"
MANIFESTS = {"package.json": "json", "composer.json": "json", "deno.json": "json", "deno.jsonc": "json", "bower.json": "json", "go.mod": "go", "cargo.toml": "toml", "pyproject.toml": "toml", "pipfile": "toml", "gemfile": "gem", "pubspec.yaml": "yaml", "mix.exs": "mix", "build.gradle": "gradle", "build.gradle.kts": "gradle", "package.swift": "swift"}
VERSION_LIKE = r"^(?:[\^~>=<!*v ]|==)*\d"
VERSION_WORDS = r"^(\*$|latest$|workspace:|npm:|file:|link:|git\+|github:)"
# fmt: on

# Path rules: for each category, words of each kind. dirs: any directory; at: start of the path; base: whole name; begins, ends: of the name.
LOCK_FILES = "package-lock.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock go.sum cargo.lock poetry.lock pipfile.lock composer.lock gemfile.lock pdm.lock uv.lock flake.lock packages.lock.json pubspec.lock mix.lock gradle.lockfile podfile.lock shrinkwrap.yaml npm-shrinkwrap.json requirements.lock deno.lock renv.lock"
BUILD_FILES = "package.json go.mod cargo.toml pyproject.toml setup.py setup.cfg pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts composer.json gemfile makefile gnumakefile cmakelists.txt dockerfile meson.build build.zig build.zig.zon mix.exs pubspec.yaml requirements.txt requirements-dev.txt pipfile package.swift podfile build.sbt bazel build build.bazel workspace workspace.bazel module.bazel justfile taskfile.yml taskfile.yaml magefile.go gulpfile.js gruntfile.js webpack.config.js webpack.config.ts vite.config.ts vite.config.js vite.config.mts rollup.config.js rollup.config.ts rollup.config.mjs tsup.config.ts esbuild.config.js tsconfig.json tsconfig.build.json babel.config.js .babelrc lerna.json nx.json turbo.json pnpm-workspace.yaml rush.json deno.json deno.jsonc conanfile.txt conanfile.py vcpkg.json configure.ac makefile.am manifest.in tox.ini noxfile.py cabal.project stack.yaml dune-project build.xml gradle.properties project.clj deps.edn .tool-versions .nvmrc .node-version .python-version .ruby-version .go-version rust-toolchain rust-toolchain.toml netlify.toml vercel.json wrangler.toml goreleaser.yml goreleaser.yaml .goreleaser.yml .goreleaser.yaml dockerfile.dev docker-compose.yml docker-compose.yaml compose.yml compose.yaml nuxt.config.ts nuxt.config.js next.config.js next.config.mjs next.config.ts angular.json svelte.config.js astro.config.mjs tailwind.config.js tailwind.config.ts postcss.config.js postcss.config.cjs vitest.config.ts jest.config.js jest.config.ts karma.conf.js playwright.config.ts cypress.config.ts cypress.config.js flake.nix default.nix shell.nix renovate.json renovate.json5 .renovaterc .renovaterc.json dependabot.yml cargo.nix gemspec sonar-project.properties"
CONFIG_FILES = ".editorconfig .gitignore .gitattributes .gitmodules .dockerignore .npmignore .prettierrc .prettierrc.json .prettierrc.js .prettierrc.cjs .prettierrc.yaml .prettierignore .eslintrc .eslintrc.js .eslintrc.cjs .eslintrc.json .eslintrc.yml .eslintignore eslint.config.js eslint.config.mjs eslint.config.ts eslint.config.cjs biome.json biome.jsonc .stylelintrc .stylelintrc.json stylelint.config.js .golangci.yml .golangci.yaml .golangci.toml .rubocop.yml .flake8 .pylintrc pylintrc mypy.ini .mypy.ini ruff.toml .ruff.toml .pre-commit-config.yaml .commitlintrc .commitlintrc.json .commitlintrc.js commitlint.config.js commitlint.config.ts .czrc .cz.toml .huskyrc .lintstagedrc .lintstagedrc.json lint-staged.config.js .mailmap codeowners .codeowners funding.yml .markdownlint.json .markdownlint.yaml .yamllint .yamllint.yml .hadolint.yaml .shellcheckrc .clang-format .clang-tidy .rustfmt.toml rustfmt.toml clippy.toml .clippy.toml .php-cs-fixer.php .php-cs-fixer.dist.php phpstan.neon phpstan.neon.dist psalm.xml .phpcs.xml phpcs.xml phpcs.xml.dist .swiftlint.yml detekt.yml .detekt.yml checkstyle.xml .editorconfig.json .gitpod.yml .devcontainer.json devcontainer.json .codespellrc .cspell.json cspell.json .typos.toml typos.toml .vscode .idea .env.example .env.sample .coveragerc codecov.yml .codecov.yml sonar-project.properties .nycrc .c8rc.json"
CHANGELOG_FILES = "changelog.md changelog changes.md history.md changelog.rst changelog.txt release-notes.md releases.md news.md news.rst news changes changes.rst history.rst changelog.mdx release_notes.md"
LICENSE_FILES = "license license.md license.txt licence licence.md copying copying.md notice notice.md notice.txt unlicense license-mit license-apache code_of_conduct.md codeofconduct.md contributing.md contributors.md authors authors.md maintainers.md security.md support.md governance.md citation.cff"
VERSION_FILES = "version version.txt version.go version.py __version__.py _version.py version.rb version.ts version.js version.json .version version.h version.cmake version.rs version.php version.java version.kt version.swift version.mjs"
DOC_EXT = "md mdx rst txt adoc asciidoc org tex man 1 5 7 8 pod rdoc textile wiki markdown mkd livemd"
STYLE_EXT = "css scss sass less styl pcss postcss"
ASSET_EXT = "png jpg jpeg gif webp avif ico icns bmp tiff tif svg woff woff2 ttf otf eot mp3 mp4 wav ogg webm mov pdf psd ai sketch fig zip gz tgz tar jar wasm so dll dylib exe bin dat pak glb gltf obj fbx blend hdr exr dds ktx flac aac m4a heic cur ani xcf pyc class o a lib pdb sqlite db"
I18N_EXT = "po pot mo xlf xliff arb resx strings stringsdict ftl"
DATA_EXT = "json json5 jsonc yaml yml toml csv tsv xml ini cfg conf properties plist ndjson jsonl env hcl tfvars"
SCHEMA_EXT = "sql proto graphql gql prisma avsc thrift fbs capnp xsd wsdl openapi dbml cue"
TEMPLATE_EXT = "html htm tmpl tpl hbs handlebars mustache ejs pug jade njk twig erb haml slim liquid j2 jinja jinja2 xhtml gotmpl gohtml eex heex leex"
SCRIPT_EXT = "sh bash zsh fish bat cmd ps1 psm1 nu awk"
SNAPSHOT_EXT = "snap golden approved received expected out stdout stderr exp fixture vcr cassette"
CI_AT = ".github/workflows/ .github/actions/ .circleci/ .gitlab/ .buildkite/ .woodpecker .teamcity/ .azure-pipelines/ .ci/ ci/ .semaphore/ .forgejo/workflows/ .gitea/workflows/"
CI_FILES = ".gitlab-ci.yml .travis.yml appveyor.yml .appveyor.yml jenkinsfile azure-pipelines.yml bitbucket-pipelines.yml .drone.yml cloudbuild.yaml cloudbuild.yml codemagic.yaml .cirrus.yml .mergify.yml .mergify.yaml wercker.yml .scrutinizer.yml"
CHANGELOG_AT = ".changeset/ changelog.d/ changelogs/ changes/ news.d/ .changes/ changelog/ release-notes/ releasenotes/ doc/release/upcoming_changes/ doc/source/whatsnew/ doc/whats_new/ docs/changelog/ unreleased/ towncrier/ doc/changes/"
GENERATED_DIRS = "vendor node_modules third_party thirdparty third-party generated gen __generated__ _generated autogen auto-generated .yarn dist build out target"
GENERATED_ENDS = ".pb.go .pb.cc .pb.h _pb2.py _pb2_grpc.py .g.dart .freezed.dart .min.js .min.css .bundle.js _generated.go .gen.go .gen.ts _string.go .d.ts.map .js.map zz_generated .swagger.json .pb.swift .mock.go _mock.go"
SNAPSHOT_DIRS = "__snapshots__ snapshots __fixtures__ fixtures testdata test_data golden goldens __mocks__ cassettes vcr_cassettes expected baselines __image_snapshots__ recordings"
TEST_DIRS = "test tests __tests__ spec specs e2e integration integration-tests integration_tests unittest unittests unit_tests unit-tests testing tests-e2e test-e2e cypress playwright __test__ t testsuite test_suite acceptance functional regression benchmarks benchmark bench benches testutil testutils test-utils test_utils testhelpers test-helpers __integration__ __e2e__ smoke tests_integration test-integration e2e-tests test/e2e testkit testcases test_cases features"
TEST_FILES = "conftest.py pytest.ini phpunit.xml phpunit.xml.dist .rspec codeception.yml"
DOC_DIRS = "docs doc documentation website site wiki manual guide guides handbook man docsrc docsite examples example samples sample demo demos tutorials tutorial adr adrs rfcs rfc design-docs proposals blog book .github/issue_template issue_template pull_request_template .vitepress"
DOC_FILES = "docs.go doc.go mkdocs.yml mkdocs.yaml docusaurus.config.js docusaurus.config.ts .readthedocs.yaml .readthedocs.yml typedoc.json book.toml _config.yml jsdoc.json .vitepress"
DOC_AT = ".github/issue_template .github/pull_request_template .github/discussion_template"
I18N_DIRS = "i18n locales locale translations translation lang langs l10n intl messages _locales localization localizations"
I18N_FILES = "en.json en-us.json fr.json de.json zh-cn.json ja.json"
BUILD_ENDS = ".dockerfile .csproj .fsproj .vbproj .sln .props .targets .nuspec .gemspec .cabal .podspec .pbxproj .xcconfig .xcscheme .flatpak.yml"
BUILD_EXT = "gradle cmake mk bzl nix bazel ninja nuspec ebuild"
BUILD_BEGINS = "dockerfile webpack. vite.config rollup.config tsconfig. jest.config vitest.config tsup.config esbuild. docker-compose babel.config gradle-wrapper"
BUILD_DIRS = "gradle cmake .cargo scripts/build build-tools buildtools tools/build .docker docker deploy deployment helm charts k8s kubernetes terraform infra infrastructure packaging pkg/packaging release releases installer dist-scripts"
BUILD_MORE = "pkgbuild snapcraft.yaml flatpak.json electron-builder.yml electron-builder.json tauri.conf.json app.json eas.json fastfile appfile matchfile gymfile info.plist androidmanifest.xml proguard-rules.pro build.rs poetry.toml mise.toml .mise.toml deno.json wails.json sam.yaml"
CONFIG_DIRS = ".vscode .idea .devcontainer .husky .config .github .gitlab"
CONFIG_BEGINS = ".eslintrc .prettierrc .stylelintrc .babelrc .lintstagedrc .commitlintrc .releaserc .npmrc .yarnrc .env .versionrc .swcrc .oxlintrc"
CONFIG_MORE = "lefthook.yml .lefthook.yml release-please-config.json .release-please-manifest.json cliff.toml .mocharc.js .mocharc.json .mocharc.yml knip.json .knip.json lefthook.yaml dprint.json oxlint.json"
ASSET_DIRS = "assets static public images img icons fonts media resources/images res/drawable res/mipmap"
SCHEMA_DIRS = "schema schemas proto protos openapi swagger"
MIGRATION_DIRS = "migrations migration db/migrate alembic/versions"
SCHEMA_FILES = "schema.graphql openapi.yaml openapi.json swagger.yaml swagger.json"
SCRIPT_DIRS = "scripts script bin tools tool hack utils/scripts dev .dev devtools"
SCRIPT_LAST_DIRS = "tools scripts hack dev devtools tooling"
TEMPLATE_DIRS = "templates template views layouts partials _includes _layouts"
