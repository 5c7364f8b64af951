"""Scalar expressions over paths, names, commands and claims; all are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- paths


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def short_path(path: Column, keep: int = 2) -> Column:
    return F.substring_index(path, "/", -keep)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def node_id(label: Column, name: Column) -> Column:
    return F.concat(label, F.lit(":"), name)


#: Extension -> language.  Fixed values.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".phtml": "php", ".swift": "swift",
}


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


#: Folders, endings and file names that hold no source of their own.  Fixed values.
IGNORED_FOLDERS = """
.git .svn .hg .bzr
.idea .vscode .vs .eclipse .settings .DS_Store Thumbs.db
node_modules bower_components jspm_packages vendor venv .venv env .env __pycache__ .pytest_cache .mypy_cache site-packages .tox eggs .eggs
lib64 parts sdist wheels
dist build out output bin obj target .next .nuxt .output .vercel .netlify .serverless _build public/build .parcel-cache .turbo .svelte-kit
coverage .nyc_output htmlcov .coverage __tests__ __mocks__ .jest
logs log tmp temp cache .cache .tmp .temp
.generated generated auto-generated .terraform
.husky .github .circleci .gitlab fixtures snapshots __snapshots__
.pipeline-worktrees .pipeline-worktree .pipeline _pipeline
""".split()
IGNORED_EXTENSIONS = """
.png .jpg .jpeg .gif .svg .ico .webp .bmp .tiff .tif .psd .ai .sketch .fig .xd
.zip .tar .gz .rar .7z .bz2 .xz .tgz
.exe .dll .so .dylib .a .lib .o .obj .class .jar .war .ear .pyc .pyo .pyd .beam .wasm .node
.pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp
.mp4 .mp3 .wav .mov .avi .mkv .flv .wmv .ogg .webm .flac .aac .m4a
.woff .woff2 .ttf .eot .otf
.db .sqlite .sqlite3 .mdb .accdb
.min.js .min.css .bundle.js .chunk.js .map .lock
.pem .key .crt .cer .p12 .pfx
.csv .tsv .parquet .avro .feather .npy .npz .pkl .pickle .h5 .hdf5
.bin .dat .data .raw .iso .img .dmg
""".split()
IGNORED_NAMES = """
package-lock.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock poetry.lock Cargo.lock go.sum
.gitignore .gitattributes .npmrc .yarnrc .editorconfig .prettierrc .prettierignore .eslintignore .dockerignore Thumbs.db .DS_Store
LICENSE LICENSE.md LICENSE.txt CHANGELOG.md CHANGELOG CONTRIBUTING.md CODE_OF_CONDUCT.md SECURITY.md
.env .env.local .env.development .env.production .env.test .env.example
""".split()
IGNORED_PARTS = r"\.bundle\.|\.chunk\.|\.generated\.|\.d\.ts$"


def ignored(path: Column, folders: list[str] = IGNORED_FOLDERS, extensions: list[str] = IGNORED_EXTENSIONS, names: list[str] = IGNORED_NAMES) -> Column:
    """A path with a part among the folders, one of the endings (of one or two dots), one of the file names, or the mark of
    generated code in its name."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    name = base_name(slashed)
    low = F.lower(name)
    ends = F.array(F.regexp_extract(low, r"(\.[^.]*)$", 1), F.regexp_extract(low, r"(\.[^.]*\.[^.]*)$", 1))
    some = lambda c, values: F.arrays_overlap(c, F.array(*[F.lit(x) for x in values]).cast("array<string>"))
    return some(F.split(slashed, "/"), folders) | some(F.array(name, low), names) | some(ends, extensions) | low.rlike(IGNORED_PARTS)


def _norm(path: Column) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))


#: Parts of a path that mark a test file, in three forms that differ.  Fixed values.
TEST_1 = r"\.test\.|\.spec\.|__tests__/|__mocks__/|/test/|/tests/|/testing/|/fixtures/|_test\.go|_test\.py|/test_|/conftest\."
TEST_2 = (
    r"\.test\.|\.spec\.|__tests__/|__mocks__/|/test/|/tests/|/testing/|_test\.py$|/test_|_test\.go$|/src/test/|tests\.swift$|test\.swift$|uitests/|"
    r"\.tests/|tests\.cs|test\.php$|spec\.php$|/tests/feature/|/tests/unit/"
)
TEST_3 = r"\.test\.|\.spec\.|__tests__/|__mocks__/|/test/|/tests/|/testing/|/fixtures/|_test\.go$|_test\.py$|/test_|/conftest\."
UTILITY = r"/utils/|/util/|/helpers/|/helper/|/common/|/shared/|/lib/|/utils\.ts$|/utils\.js$|/helpers\.ts$|/helpers\.js$|_utils\.py$|_helpers\.py$"


def is_test_v1(path: Column) -> Column:
    return F.lower(path).rlike(TEST_1)


def is_test_v2(path: Column) -> Column:
    return _norm(path).rlike(TEST_2)


def is_test_v3(path: Column) -> Column:
    return _norm(path).rlike(TEST_3)


def is_utility(path: Column) -> Column:
    return _norm(path).rlike(UTILITY)


#: Ordered: pattern on the lower-cased path with a leading slash, what it must not match, framework, multiplier.  The first
#: that fits decides.  Fixed values.
FRAMEWORKS = (
    (r"/pages/.*\.(tsx|ts|jsx|js)$", r"/_|/api/", "nextjs-pages", 3.0),
    (r"/app/.*page\.(tsx|ts|jsx|js)$", None, "nextjs-app", 3.0),
    (r"/pages/api/|(?=.*/app/)(?=.*/api/).*route\.ts$", None, "nextjs-api", 3.0),
    (r"/app/.*layout\.(tsx|ts)$", None, "nextjs-app", 2.0),
    (r"/routes/.*\.(ts|js)$", None, "express", 2.5),
    (r"/controllers/.*\.(ts|js)$", None, "mvc", 2.5),
    (r"/handlers/.*\.(ts|js)$", None, "handlers", 2.5),
    (r"views\.py$", None, "django", 3.0),
    (r"urls\.py$", None, "django", 2.0),
    (r"/(routers|endpoints|routes)/.*\.py$", None, "fastapi", 2.5),
    (r"/api/.*\.py$", r"__init__\.py$", "python-api", 2.0),
    (r"/controllers?/.*\.java$|controller\.java$", None, "spring", 3.0),
    (r"/services?/.*\.java$", None, "java-service", 1.8),
    (r"/controllers?/.*\.kt$|controller\.kt$", None, "spring-kotlin", 3.0),
    (r"/routes/.*\.kt$", None, "ktor", 2.5),
    (r"/plugins/.*\.kt$", None, "ktor", 2.0),
    (r"(routing|routes)\.kt$", None, "ktor", 2.5),
    (r"/(activity|ui)/.*\.kt$|(activity|fragment)\.kt$", None, "android-kotlin", 2.5),
    (r"/main\.kt$", None, "kotlin", 3.0),
    (r"/application\.kt$", None, "kotlin", 2.5),
    (r"/controllers/.*\.cs$|controller\.cs$", None, "aspnet", 3.0),
    (r"/pages/.*\.razor$", None, "blazor", 2.5),
    (r"/handlers?/.*\.go$|/routes/.*\.go$", None, "go-http", 2.5),
    (r"/controllers/.*\.go$", None, "go-mvc", 2.5),
    (r"/main\.go$", None, "go", 3.0),
    (r"/(handlers|routes)/.*\.rs$", None, "rust-web", 2.5),
    (r"/main\.rs$", None, "rust", 3.0),
    (r"/bin/.*\.rs$", None, "rust", 2.5),
    (r"/main\.(c|cpp|cc)$", None, "c-cpp", 3.0),
    (r"/src/(.*/)?app\.(c|cpp)$", None, "c-cpp", 2.5),
    (r"/routes/.*\.php$|/controllers/.*\.php$|controller\.php$", None, "laravel", 3.0),
    (r"/commands/.*\.php$|/jobs/.*\.php$|/listeners/.*\.php$|/http/middleware/.*\.php$", None, "laravel", 2.5),
    (r"/providers/.*\.php$", None, "laravel", 1.8),
    (r"/policies/.*\.php$", None, "laravel", 2.0),
    (r"/models/.*\.php$", None, "laravel", 1.5),
    (r"/services/.*\.php$", None, "laravel", 1.8),
    (r"/repositories/.*\.php$", None, "laravel", 1.5),
    (r"/(appdelegate|scenedelegate|app)\.swift$", None, "ios", 3.0),
    (r"/sources/.*app\.swift$", None, "swiftui", 3.0),
    (r"/(viewcontrollers|controllers|screens)/.*\.swift$|viewcontroller\.swift$|vc\.swift$", None, "uikit", 2.5),
    (r"/coordinators/.*\.swift$|coordinator\.swift$", None, "ios-coordinator", 2.5),
    (r"/(views|scenes)/.*\.swift$", None, "swiftui", 1.8),
    (r"/services/.*\.swift$", None, "ios-service", 1.8),
    (r"/router/.*\.swift$", None, "ios-router", 2.0),
    (r"/api/(.*/)?(index\.ts|index\.js|__init__\.py)$", None, "api", 1.8),
)


def framework(path: Column) -> Column:
    """struct(framework, multiplier) of the first rule that fits; null without one."""
    p = _norm(path)
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    out = None
    for pattern, unless, name, k in FRAMEWORKS:
        ok = p.rlike(pattern) if unless is None else p.rlike(pattern) & ~p.rlike(unless)
        value = F.struct(F.lit(name).alias("framework"), F.lit(k).alias("multiplier"))
        out = F.when(ok, value) if out is None else out.when(ok, value)
    return out


#: Names of entries and of helpers.  Fixed values.
ENTRY_NAMES = (
    r"^(?i:main|init|bootstrap|start|run|setup|configure)$", r"^handle[A-Z]", r"^on[A-Z]", r"Handler$", r"Controller$", r"^process[A-Z]", r"^execute[A-Z]", r"^perform[A-Z]", r"^dispatch[A-Z]", r"^trigger[A-Z]", r"^fire[A-Z]",
    r"^emit[A-Z]",
)
UTILITY_NAMES = (
    r"^(?:get|set|is|has|can|should|will|did)[A-Z]", r"^_", r"^(?i:format|parse|validate|convert|transform)", r"^(?i:log|debug|error|warn|info)$", r"^(?:to|from)[A-Z]", r"^(?i:encode|decode)", r"^(?i:serialize|deserialize)",
    r"Helper$", r"Util$", r"Utils$", r"^(?i:utils?)$", r"^(?i:helpers?)$",
)
ENTRY_NAME, UTILITY_NAME = "|".join(ENTRY_NAMES), "|".join(UTILITY_NAMES)


def entry_score(name: Column, exported: Column, callers: Column, callees: Column, path: Column, with_framework: bool = True, test_penalty: bool = False) -> Column:
    """Callees per caller, weighted by export, name, framework and (second form) test file."""
    base = callees / (callers + 1) * F.when(exported, 2.0).otherwise(1.0)
    score = base * F.when(name.rlike(UTILITY_NAME), 0.3).when(name.rlike(ENTRY_NAME), 1.5).otherwise(1.0)
    if with_framework:
        score = score * F.coalesce(framework(path)["multiplier"], F.lit(1.0))
    if test_penalty:
        score = score * F.when(is_test_v2(path), 0.1).otherwise(1.0)
    return F.round(F.when(callees == 0, 0.0).otherwise(score), 6)


# ---------------------------------------------------------------- code

#: Fixed values.
CONSTRUCTOR_LANGUAGES = ("swift", "kotlin", "java", "csharp")


def call_form(name: Column, receiver: Column, lang: Column) -> Column:
    upper = lambda c: F.substring(c, 1, 1).rlike(r"\p{Lu}")
    return (
        F.when(receiver == "super", "super").when(receiver.isin("self", "this"), "member").when((receiver != "") & upper(receiver), "static").when(receiver != "", "member")
        .when(name == "__init__", "constructor").when(upper(name) & lang.isin(list(CONSTRUCTOR_LANGUAGES)), "constructor").otherwise("free")
    )


def is_exported(name: Column, lang: Column, modifiers: Column, export_keyword: Column) -> Column:
    has = lambda m: F.coalesce(F.array_contains(modifiers, m), F.lit(False))
    return (
        F.when(lang == "python", ~name.startswith("_")).when(lang == "go", name.rlike(r"^\p{Lu}")).when(lang == "swift", has("public")).when(lang == "rust", has("pub"))
        .when(lang.isin("typescript", "javascript"), export_keyword).when(lang == "csharp", ~has("private") & ~has("internal"))
        .when(lang.isin("kotlin", "ruby", "java", "c", "cpp", "php"), ~has("private")).otherwise(F.lit(True))
    )


#: Tiers from the most to the least dangerous.  Fixed values.
SECURITY_TIERS = (
    (10, "block", r"rm\s+-rf\s+/\s*$|rm\s+-rf\s+/\b|\bmkfs\b|(?i:\bformat\s+[a-zA-Z]:)|dd\s+.*of=/dev/"),
    (9, "block", r"(?:>|tee)\s+/etc/|(?:>|tee)\s+/usr/|(?:>|tee)\s+/sys/|mv\s+.*\s+/etc/"),
    (8, "block", r"\bkill\b|\bpkill\b|\bkillall\b"),
    (7, "ask", r"\bchmod\b|\bchown\b|\bchgrp\b"),
    (6, "ask", r"\bdocker\s+(?:run|build|exec)\b|\bpodman\s+(?:run|build|exec)\b"),
    (5, "allow", r"\bgit\s+(?:commit|push|tag)\b|\bnpm\s+publish\b|\btwine\s+upload\b"),
    (4, "allow", r"\becho\s.*>|\btouch\b|\bmkdir\b|\bcp\b"),
    (3, "allow", r"\bpip\s+(?:list|show|freeze)\b|\bnpm\s+(?:ls|list)\b"),
    (2, "allow", r"\buname\b|\bwhich\b|\benv\b|\bprintenv\b"),
)


def security_tier(command: Column) -> Column:
    out = None
    for tier, _, p in SECURITY_TIERS:
        out = F.when(command.rlike(p), tier) if out is None else out.when(command.rlike(p), tier)
    return out.otherwise(1)


def tier_action(tier: Column) -> Column:
    return F.when(tier >= 8, "block").when(tier >= 6, "ask").otherwise("allow")


# ---------------------------------------------------------------- claims

#: Fixed values.
CONJUNCTIONS = (" and ", " but ", " also ", " while ", " whereas ", "; ")


def _bare(claim: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(claim, r"\[PRIORITY:(\d+)\]", ""), r"\[CONTEXT:([^\]]+)\]", ""))


def is_atomic(claim: Column) -> Column:
    t = _bare(claim)
    joined = F.lit(False)
    for c in CONJUNCTIONS:
        joined = joined | F.contains(F.lower(t), F.lit(c))
    return ~joined & (F.regexp_count(t, F.lit(r"(?i)\b(?:is|are|was|were|has|have|does|do)\b")) <= 1)


def split_claim(claim: Column) -> Column:
    """Parts of a claim between conjunctions (case counts), trimmed, without empty ones."""
    parts = F.split(claim, " and | but | also | while | whereas |; ")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def claim_priority(claim: Column, default: int = 50) -> Column:
    n = F.regexp_extract(claim, r"\[PRIORITY:(\d+)\]", 1)
    return F.when(n == "", default).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), n.try_cast("int"))))


# ---------------------------------------------------------------- strings


def capitalise(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def sanitise(s: Column, length: int = 20) -> Column:
    return F.lower(F.left(F.regexp_replace(s, "[^a-zA-Z0-9]", "_"), F.lit(length)))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def token_estimate(s: Column) -> Column:
    return (F.floor(F.length(s) / 4) + 1).cast("int")


def clean_content(s: Column) -> Column:
    t = F.regexp_replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t\f\x0B\r]+$", ""), r"\A\s+|\s+\z", "")


def truncate_content(s: Column, most: int) -> Column:
    head = F.left(s, F.lit(most))
    gap = F.lit(most) - F.instr(F.reverse(head), " ")  # 0-based place of the last space; most if none
    return F.when(F.length(s) <= most, s).when((F.instr(head, " ") > 0) & (gap > most * 0.8), F.concat(head.substr(F.lit(1), gap), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))


def embedding_text(label: Column, name: Column, path: Column, content: Column, most: int = 500) -> Column:
    folder = dir_name(path)
    snippet = truncate_content(clean_content(content), most)
    return F.concat(
        label, F.lit(": "), name, F.lit("\nFile: "), base_name(path), F.when(folder != "", F.concat(F.lit("\nDirectory: "), folder)).otherwise(""),
        F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit("\n\n"), snippet)).otherwise(""),
    )


def embedding_text_short(label: Column, name: Column, path: Column, signature: Column, docstring: Column) -> Column:
    return F.concat_ws("\n", F.concat(label, F.lit(" "), name, F.lit(" in "), path), F.nullif(signature, F.lit("")), F.nullif(docstring, F.lit("")))


def disclose(value: Column, level: int, most: int = 120) -> Column:
    """Level 1 shows the type, 2 the value cut at ``most`` characters, 3 the whole."""
    if level == 1:
        return F.typeof(value)
    s = value.cast("string")
    return s if level == 3 else F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit("..."))).otherwise(s)


def strip_line_comments(s: Column) -> Column:
    return F.regexp_replace(s, r"(?m)//.*$", "")


def first_json_object(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"\{[\s\S]*\}", 0), F.lit(""))


def csv_field(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(s, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit('"'), F.lit('""')), F.lit('"'))


#: Words that make a statement a write, and statements that are refused by their first word.  Fixed values.
WRITE_WORDS = r"(?i)\b(CREATE|DELETE|SET|MERGE|REMOVE|DROP|ALTER|COPY|DETACH)\b"
WRITE_HEADS = r"(?i)^\s*(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)"


def has_write_word(sql: Column) -> Column:
    return sql.rlike(WRITE_WORDS)


def starts_with_write(sql: Column) -> Column:
    return sql.rlike(WRITE_HEADS)
