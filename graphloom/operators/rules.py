"""Document checker: 64 rules as boolean columns of one projection, their penalties, and ten dimension scorers
with a gate.  No rule needs a Python function: each is an expression over ``content`` or over the nested
columns of an artifact, so a scan of the documents with all rules is one stage.

An artifact has content STRING and, where they exist, title STRING, sections ARRAY<STRING>, requirements and
tests and stories and sprints and files ARRAY<STRUCT>, verdicts ARRAY<STRING>, nfrs ARRAY<STRING>, self_check STRING,
codebase_provided BOOLEAN, codebase_analysis STRING.  A missing column counts as its default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL, WARNING = "critical", "warning"
PENALTY = {CRITICAL: 0.15, WARNING: 0.05}

# Section names, sources, suffixes and patterns that the rules are defined by.
SECTIONS = ("Overview", "Requirements", "User Stories", "Technical", "Acceptance", "Roadmap", "Testing")
SOURCES = ("User Request", "Clarification", "Codebase", "Mockup")
BANNED_SUFFIXES = ("Utils", "Helper", "Helpers", "Manager", "Handler", "Processor")
SECRETS = (
    r"(?:api[_-]?key|apikey)\s*[=:]\s*['\"][^'\"]{8,}",
    r"(?:secret|token|password)\s*[=:]\s*['\"][^'\"]{8,}",
    r"sk-[a-zA-Z0-9]{20,}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"-----BEGIN (?:RSA )?PRIVATE KEY-----",
)
FORCE = (r"!\s*$", r"try!\s", r"as!\s", r"force_unwrap", r"\.unwrap\(\)")
SOLID = (("srp", "single responsibility"), ("ocp", "open/closed"), ("lsp", "liskov"), ("isp", "interface segregation"), ("dip", "dependency inversion"))

#: id -> (name, category, severity, words that call for care, words that show it): fails when some of the first stand in
#: the lower-cased text and none of the second.  Fixed values.
KEYWORD_RULES: dict[int, tuple[str, str, str, tuple[str, ...], tuple[str, ...]]] = {
    12: ("clean_architecture", "structural_extended", WARNING, ("technical", "architecture"), ("port", "adapter", "interface", "protocol", "abstraction")),
    32: ("input_sanitization", "security", CRITICAL, ("user input", "form data", "request body", "query param"), ("sanitiz", "validat", "escape", "parameterized")),
    33: ("auth_requirements", "security", CRITICAL, ("api", "endpoint", "route", "service"), ("authenticat", "authoriz", "oauth", "jwt", "rbac")),
    34: ("encryption_at_rest", "security", CRITICAL, ("password", "credential", "pii", "personal data", "sensitive"), ("encrypt", "aes", "hashing", "bcrypt", "argon")),
    35: ("gdpr_compliance", "security", WARNING, ("personal data", "pii", "user data", "email", "name", "address"), ("gdpr", "retention", "consent", "right to delete", "data protection")),
    38: ("data_residency", "security", WARNING, ("database", "storage", "cloud", "s3", "blob"), ("region", "residency", "data location", "jurisdiction")),
    40: ("retry_logic", "resilience", WARNING, ("http", "api call", "external service", "network"), ("retry", "backoff", "exponential", "tenacity")),
    41: ("timeout_handling", "resilience", WARNING, ("http", "api", "external", "network", "database"), ("timeout", "deadline", "time_limit", "cancel")),
    42: ("circuit_breaker", "resilience", WARNING, ("microservice", "external service", "third-party", "downstream"), ("circuit breaker", "circuit_breaker", "bulkhead", "fallback")),
    43: ("graceful_degradation", "resilience", WARNING, ("dependency", "external", "service", "integration"), ("fallback", "graceful", "degrade", "offline", "cache")),
    44: ("race_condition_prevention", "resilience", CRITICAL, ("concurrent", "parallel", "thread", "async", "actor"), ("lock", "mutex", "semaphore", "actor isolation", "sendable", "atomic", "serial queue")),
    45: ("atomicity", "resilience", WARNING, ("update", "write", "delete", "insert", "modify", "state change"), ("atomic", "transaction", "rollback", "compensat", "saga")),
    46: ("deadlock_prevention", "resilience", CRITICAL, ("lock", "mutex", "semaphore", "synchronized"), ("lock ordering", "actor", "deadlock", "timeout")),
    48: ("complexity_limit", "quality", WARNING, ("complex", "nested", "deeply"), ("cyclomatic", "complexity limit", "extract", "refactor", "simplif")),
    49: ("duplication_prevention", "quality", WARNING, ("duplicate", "copy", "similar code"), ("dry", "don't repeat", "shared", "common", "extract", "reuse")),
    51: ("documentation", "quality", WARNING, ("public func", "public class", "def ", "export"), ("docstring", "documentation", "/// ", '"""', "jsdoc")),
    53: ("test_coverage_requirement", "quality", WARNING, ("test",), ("coverage", "80%", "90%", "100%", "threshold")),
    54: ("edge_case_testing", "quality", WARNING, ("test",), ("edge case", "boundary", "corner case", "empty", "null", "zero", "overflow")),
    55: ("integration_testing", "quality", WARNING, ("module", "service", "component", "layer"), ("integration test", "end-to-end", "e2e", "system test")),
    56: ("performance_testing", "quality", WARNING, ("performance", "latency", "throughput", "response time"), ("benchmark", "load test", "performance test", "stress test")),
    57: ("regression_testing", "quality", WARNING, ("test",), ("regression", "ci/cd", "continuous", "automated test", "pipeline")),
    58: ("test_isolation", "quality", WARNING, ("test",), ("isolat", "independent", "no shared state", "fixture", "setup", "teardown")),
    59: ("logging_strategy", "observability", WARNING, ("service", "api", "endpoint", "module"), ("logging", "log level", "structured log", "logger")),
    60: ("metrics_emission", "observability", WARNING, ("operation", "endpoint", "transaction", "request"), ("metric", "counter", "histogram", "gauge", "prometheus", "datadog")),
    61: ("alerting_thresholds", "observability", WARNING, ("metric", "monitor", "sla", "slo"), ("alert", "threshold", "pager", "oncall", "notification")),
    62: ("trace_correlation", "observability", WARNING, ("distributed", "microservice", "multi-service", "cross-service"), ("trace", "correlation id", "request id", "span", "opentelemetry")),
    63: ("dependency_pinning", "observability", WARNING, ("dependency", "package", "library", "module"), ("pin", "lock", "exact version", ">=", "==", "requirements.txt", "package-lock")),
    64: ("vulnerability_scanning", "observability", WARNING, ("ci/cd", "pipeline", "github actions", "deployment"), ("vulnerability", "security scan", "dependabot", "snyk", "trivy", "audit")),
}

#: id -> (name, category, severity, pattern): fails when the pattern is found.  Fixed values.
PATTERN_RULES: dict[int, tuple[str, str, str, str]] = {
    5: ("no_volatile_indexes", "structural", CRITICAL, r"(?i)(?:CREATE\s+INDEX|WHERE).*NOW\(\)"),
    7: ("no_placeholder_tests", "structural", CRITICAL, r"(?m)(?:def\s+test_\w+.*?:)\s*(?:pass|\.\.\.)\s*$"),
    8: ("sp_not_in_fr_table", "structural", WARNING, r"\|\s*FR-\d+\s*\|.*\|\s*\d+\s*SP\s*\|"),
    18: ("generic_over_specific", "structural_extended", WARNING, r"(?i)(?:hardcode|hard-code|magic\s+number|specific\s+to\s+\w+)"),
    19: ("no_nested_types", "structural_extended", CRITICAL, r"(?:struct|class|enum)\s+\w+\s*\{[^}]*(?:struct|class|enum)\s+\w+"),
    24: ("dependency_direction", "architecture", CRITICAL, r"(?i)(?:Domain|Model)\s*(?:import|depend|reference).*(?:Presentation|UI|View)"),
    25: ("no_god_objects", "architecture", CRITICAL, r"\b\w+(?:" + "|".join(BANNED_SUFFIXES) + r")\b"),
    29: ("no_backward_compat_hacks", "architecture", CRITICAL, r"(?:typealias|@available\s*\(\s*\*\s*,\s*deprecated|#if\s+swift)"),
    31: ("no_hardcoded_secrets", "security", CRITICAL, "(?i)(?:" + "|".join(SECRETS) + ")"),
    36: ("no_force_operations", "security", CRITICAL, "(?:" + "|".join(FORCE) + ")"),
    37: ("env_file_prohibition", "security", CRITICAL, r"\.env\b|dotenv|load_dotenv"),
    39: ("no_bare_except", "resilience", CRITICAL, r"except\s*:"),
    47: ("naming_conventions", "quality", WARNING, r"(?i)\b(?:mgr|svc|impl|util|tmp|usr|btn|lbl)\b"),
    52: ("no_todo_in_production", "quality", CRITICAL, r"\b(?:TODO|FIXME|HACK|XXX)\b"),
}


@dataclass(frozen=True)
class Rule:
    rule_id: int
    name: str
    category: str
    severity: str
    passed: Callable[[DataFrame], Column]


RULES: dict[int, Rule] = {}


def register(rule_id: int, name: str, category: str, severity: str, passed: Callable[[DataFrame], Column]) -> None:
    """Adds or replaces a rule; ``passed`` builds a boolean column from the artifacts."""
    RULES[rule_id] = Rule(rule_id, name, category, severity, passed)


def _rule(rule_id: int, name: str, category: str, severity: str):
    def keep(f):
        register(rule_id, name, category, severity, f)
        return f

    return keep


def _text(_: DataFrame) -> Column:
    return F.coalesce(F.col("content"), F.lit(""))


LOWERED = "_lowered"


def _low(df: DataFrame) -> Column:
    return F.col(LOWERED) if _has(df, LOWERED) else F.lower(_text(df))


def lowered(artifacts: DataFrame) -> DataFrame:
    """With the lower-cased text as a column of its own, for half of the rules look into it."""
    return artifacts.withColumn(LOWERED, F.lower(_text(artifacts)))


def _has(df: DataFrame, column: str) -> bool:
    return column in df.columns


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _keyword(rule_id: int):
    _, _, _, ask, show = KEYWORD_RULES[rule_id]

    def passed(df: DataFrame) -> Column:
        low = _low(df)
        asked = any_of(low, ask)
        if rule_id == 56 and _has(df, "nfrs"):
            asked = asked | (F.coalesce(F.size("nfrs"), F.lit(0)) > 0)
        return ~asked | any_of(low, show)

    return passed


for _id, (_n, _c, _s, _, _) in KEYWORD_RULES.items():
    register(_id, _n, _c, _s, _keyword(_id))
for _id, (_n, _c, _s, _p) in PATTERN_RULES.items():
    register(_id, _n, _c, _s, lambda df, p=_p: ~_text(df).rlike(p))


def _blocks(df: DataFrame, head: str = "") -> Column:
    return F.regexp_extract_all(_text(df), F.lit(f"```{head}[\\s\\S]*?```"), F.lit(0))


def _logical(lines: Column, skip: str) -> Column:
    return F.size(F.filter(lines, lambda x: (F.trim(F.translate(x, "\t\r", "  ")) != "") & ~F.trim(F.translate(x, "\t\r", "  ")).rlike(skip)))


def _ids(df: DataFrame, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_text(df), F.lit(pattern), F.lit(group))


def gap_free(numbers: Column) -> Column:
    """Whether an array of numbers, as given, is a run without gaps or repeats."""
    return (F.size(numbers) == 0) | ((F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.array_max(numbers) - F.array_min(numbers) + 1 == F.size(numbers)))


@_rule(1, "title_exists", "structural", CRITICAL)
def _(df):
    t = F.coalesce(F.col("title"), F.lit("")) if _has(df, "title") else F.lit("")
    return (F.trim(t) != "") & (F.length(t) <= 200)


@_rule(2, "sections_present", "structural", CRITICAL)
def _(df):
    if not _has(df, "sections"):
        return F.lit(False)

    def named(section: str) -> Column:
        return F.exists(F.coalesce("sections", F.array()), lambda x: F.contains(F.lower(x), F.lit(section.lower())))

    out = F.lit(True)
    for s in SECTIONS:
        out = out & named(s)
    return out


@_rule(3, "ac_numbering", "structural", WARNING)
def _(df):
    return gap_free(F.transform(_ids(df, r"AC-(\d{3})"), lambda x: x.cast("int")))


@_rule(4, "no_orphan_ddl", "structural", WARNING)
def _(df):
    names = _ids(df, r"(?i)CREATE\s+(?:TYPE|TABLE)\s+(\w+)")
    text = _text(df)
    return F.forall(names, lambda n: F.length(text) - F.length(F.replace(text, n, F.lit(""))) >= 2 * F.length(n))


@_rule(6, "fr_traceability", "structural", WARNING)
def _(df):
    if not _has(df, "requirements"):
        return F.lit(True)
    return F.forall(F.coalesce("requirements", F.array()), lambda r: F.coalesce(r["source"].isin(list(SOURCES)), F.lit(False)))


@_rule(9, "uneven_sp_distribution", "structural", WARNING)
def _(df):
    if not _has(df, "sprints"):
        return F.lit(True)
    p = F.transform(F.coalesce("sprints", F.array()), lambda s: F.coalesce(s["story_points"], F.lit(0)))
    return ~((F.size(p) > 2) & (F.size(F.array_distinct(p)) == 1))


@_rule(10, "verification_metrics_disclaimer", "structural", WARNING)
def _(df):
    return ~_text(df).rlike(r"\d+%|\d+\.\d+") | any_of(_low(df), ("projected", "estimated", "expected", "approximate"))


@_rule(11, "cross_ref_consistency", "structural_extended", WARNING)
def _(df):
    refs = _ids(df, r"(?i)(?:see|ref|refer to)\s+((?:FR|AC|STORY)-\d+)")
    return F.size(F.array_except(refs, _ids(df, r"((?:FR|AC|STORY)-\d+)"))) == 0


@_rule(13, "self_check_reported", "structural_extended", WARNING)
def _(df):
    own = F.col("self_check").isNotNull() if _has(df, "self_check") else F.lit(False)
    return own | F.contains(_low(df), F.lit("self-check"))


@_rule(14, "codebase_analysis_present", "structural_extended", WARNING)
def _(df):
    given = F.coalesce(F.col("codebase_provided"), F.lit(False)) if _has(df, "codebase_provided") else F.lit(False)
    done = F.col("codebase_analysis").isNotNull() if _has(df, "codebase_analysis") else F.lit(False)
    return ~given | done | F.contains(_low(df), F.lit("codebase analysis"))


@_rule(15, "honest_verdicts", "structural_extended", CRITICAL)
def _(df):
    if not _has(df, "verdicts"):
        return F.lit(True)
    v = F.coalesce("verdicts", F.array().cast("array<string>"))
    return ~((F.size(v) > 5) & F.forall(v, lambda x: x == "pass"))


@_rule(16, "code_matches_architecture", "structural_extended", CRITICAL)
def _(df):
    return ~F.exists(_blocks(df), lambda b: b.rlike(r"import\s+subprocess|os\.system|shutil"))


@_rule(17, "test_traceability", "structural_extended", WARNING)
def _(df):
    if not _has(df, "tests"):
        return F.lit(True)
    return F.forall(F.coalesce("tests", F.array()), lambda t: F.coalesce(t["traces_to"], F.lit("")) != "")


@_rule(20, "single_responsibility", "structural_extended", WARNING)
def _(df):
    return ~F.exists(_blocks(df), lambda b: _logical(F.split(b, "\n"), r"^(?://|#|```)") > 50)


@_rule(21, "no_self_referencing_deps", "structural_extended", CRITICAL)
def _(df):
    if not _has(df, "stories"):
        return F.lit(True)
    return ~F.exists(F.coalesce("stories", F.array()), lambda s: (F.coalesce(s["id"], F.lit("")) != "") & F.coalesce(F.array_contains(s["depends_on"], s["id"]), F.lit(False)))


@_rule(22, "id_coverage", "structural_extended", WARNING)
def _(df):
    out = F.lit(True)
    for p in ("FR", "AC", "STORY"):
        out = out & gap_free(F.array_distinct(F.transform(_ids(df, rf"{p}-(\d+)"), lambda x: x.try_cast("bigint"))))
    return out


@_rule(23, "toc_present", "structural_extended", WARNING)
def _(df):
    return (F.regexp_count(_text(df), F.lit(r"(?m)^#{1,3}\s+(.+)$")) <= 5) | any_of(_low(df), ("table of contents", "## contents"))


@_rule(26, "file_size_limit", "architecture", CRITICAL)
def _(df):
    return F.forall(F.coalesce("files", F.array()), lambda f: F.coalesce(f["lines"], F.lit(0)) <= 300) if _has(df, "files") else F.lit(True)


@_rule(27, "function_length", "architecture", WARNING)
def _(df):
    def long(b: Column) -> Column:
        parts = F.split(b, r"\n(?:def |func |fn )")
        return F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _logical(F.split(p, "\n"), r"^(?:#|//)") > 40)

    return ~F.exists(_blocks(df), long)


@_rule(28, "one_type_per_file", "architecture", CRITICAL)
def _(df):
    return F.forall(F.coalesce("files", F.array()), lambda f: F.coalesce(f["public_types"], F.lit(0)) <= 1) if _has(df, "files") else F.lit(True)


@_rule(30, "solid_compliance", "architecture", WARNING)
def _(df):
    low = _low(df)
    missing = sum((F.when(F.contains(low, F.lit(a)) | F.contains(low, F.lit(b)), 0).otherwise(1) for a, b in SOLID), F.lit(0))
    return missing <= 2


@_rule(50, "type_safety", "quality", WARNING)
def _(df):
    return ~F.exists(_blocks(df, "(?:python|swift|typescript)"), lambda b: F.contains(b, F.lit("Any")) & ~F.contains(F.lower(b), F.lit("type hint")))


# ---------------------------------------------------------------- running rules


def run_rules(artifacts: DataFrame, key: str, ids: list[int] | None = None) -> DataFrame:
    """key, rule_id, rule_name, category, severity, penalty, passed: a row for each artifact and rule."""
    some, artifacts = [RULES[i] for i in sorted(ids or RULES)], lowered(artifacts)
    rows = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(PENALTY[r.severity]).alias("penalty"), r.passed(artifacts).alias("passed"))
        for r in some
    ])
    return artifacts.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def rule_flags(artifacts: DataFrame, key: str, ids: list[int] | None = None) -> DataFrame:
    """key with one boolean column r<id> for each rule: no rows are multiplied."""
    artifacts = lowered(artifacts)
    return artifacts.select(key, *[RULES[i].passed(artifacts).alias(f"r{i}") for i in sorted(ids or RULES)])


def adjusted_scores(artifacts: DataFrame, key: str, base: float = 1.0, ids: list[int] | None = None) -> DataFrame:
    """key, total, passed, failed, adjusted_score: base less the penalties of failed rules, at least 0; computed row by row."""
    some = [RULES[i] for i in sorted(ids or RULES)]
    flags = rule_flags(artifacts, key, ids)
    lost = sum((F.when(F.col(f"r{r.rule_id}"), 0.0).otherwise(PENALTY[r.severity]) for r in some), F.lit(0.0))
    ok = sum((F.when(F.col(f"r{r.rule_id}"), 1).otherwise(0) for r in some), F.lit(0))
    return flags.select(key, F.lit(len(some)).alias("total"), ok.alias("passed"), (F.lit(len(some)) - ok).alias("failed"), F.round(F.greatest(F.lit(0.0), F.lit(base) - lost), 6).alias("adjusted_score"))


def rule_summary(results: DataFrame) -> DataFrame:
    """rule_id with the number of artifacts it failed."""
    return results.groupBy("rule_id", "rule_name", "category").agg(F.sum(F.when(F.col("passed"), 0).otherwise(1)).alias("failed"), F.count("*").alias("checked"))


def rule_counts(artifacts: DataFrame, key: str, ids: list[int] | None = None) -> DataFrame:
    """What ``rule_summary`` gives of ``run_rules``, counted beside each other: no row for each artifact and rule."""
    some = [RULES[i] for i in sorted(ids or RULES)]
    counts = [F.sum(F.when(F.col(f"r{r.rule_id}"), 0).otherwise(1)).alias(f"r{r.rule_id}") for r in some]
    one = rule_flags(artifacts, key, ids).agg(F.count("*").alias("checked"), *counts).where("checked > 0")
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.category).alias("category"), F.col(f"r{r.rule_id}").alias("failed")) for r in some])
    return one.select(F.explode(rows).alias("r"), "checked").select("r.*", "checked")


def gate_outcome(passed: Column, adjusted: Column) -> Column:
    return F.coalesce(passed, adjusted >= 0.7, F.lit(True))


# ---------------------------------------------------------------- scorers

#: Words that make a text vague.  Fixed values.
VAGUE = ("various", "several", "some", "many", "few", "often", "usually", "generally", "mostly", "things", "stuff", "etc", "and so on", "tbd", "todo")
CRITICAL_DIMENSIONS = ("d1", "d2", "d3", "d4", "d6", "d8", "d10")
ADVISORY_DIMENSIONS = ("d5", "d7", "d9")


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / F.nullif(whole, F.lit(0)))


def _section(text: Column, head: str) -> Column:
    """What follows the first header that matches up to the next second-level one; null without such a header."""
    at = F.regexp_instr(text, F.lit(head))
    rest = F.regexp_replace(F.substr(text, at), head, "\u0001")
    body = F.regexp_extract(rest, r"(?s)\A\x{01}(.*?)(?:^## |\z)".replace("(?s)", "(?sm)"), 1)
    return F.when(at > 0, body)


def scorers(content: Column) -> dict[str, Column]:
    """The ten dimension scores as columns d1..d10."""
    text = F.coalesce(content, F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    every = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    found = sum((F.when(F.contains(text, F.lit(f"## {s}")), 1).otherwise(0) for s in SECTIONS), F.lit(0))
    bad = count(r"(?m)^#{1,6}\s+.+$") - count(r"(?m)^## [A-Z][A-Za-z0-9 ]+$")
    ids = every(r"\b((?:FR|AC|STORY|NFR|TC)-\d+)\b", 1)
    spot = [F.nullif(F.instr(text, f"## {s}"), F.lit(0)) for s in SECTIONS]
    places = F.array_compact(F.array(*spot))
    in_order = F.size(F.filter(places, lambda x, i: F.forall(F.slice(places, i + 2, F.size(places)), lambda y: x < y)))
    vague = sum((F.regexp_count(F.lower(text), F.lit(rf"\b{w}\b")) for w in VAGUE), F.lit(0))
    stories = every(r"(?i)STORY-\d+[:\s].*")
    lines = every(r"(?:FR|NFR)-\d+[:\s](.*)", 1)
    assume, metrics = _section(text, r"(?im)^##\s+Assumption"), _section(text, r"(?im)^##\s+(?:Success\s+)?Metrics?")
    items = F.regexp_count(assume, F.lit(r"(?m)^\s*[-*]\s+.+"))
    goals = F.regexp_extract_all(metrics, F.lit(r"(?m)^\s*[-*]\s+.+"), F.lit(0))
    parts = F.split(text, r"(?m)^## ")
    bodies = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.array_distinct(F.regexp_extract_all(F.regexp_extract(p, r"(?s)\A[^\n]*\n(.*)\z", 1), F.lit(r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)+\b"), F.lit(0))))
    terms = F.array_distinct(F.flatten(bodies))
    crossed = F.size(F.filter(terms, lambda t: F.size(F.filter(bodies, lambda b: F.array_contains(b, t))) >= 2))
    out = {
        "d1": found / len(SECTIONS),
        "d2": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - bad * 0.1)),
        "d3": _share(F.size(F.array_distinct(ids)), F.size(ids), 0.0),
        "d4": _share(in_order, F.size(places), 0.0),
        "d5": F.when(F.size(bodies) < 2, 1.0).otherwise(_share(crossed, F.size(terms), 1.0)),
        "d6": F.greatest(F.lit(0.0), 1 - vague * 0.05),
        "d7": _share(F.size(F.filter(stories, lambda s: s.rlike(r"(?i)as a\s+\w+|stakeholder:"))), F.size(stories), 1.0),
        "d8": _share(F.size(F.filter(lines, lambda s: s.rlike(r"\d"))), F.size(lines), 0.0),
        "d9": F.when(assume.isNull() | (items == 0), 0.0).when(items >= 3, 1.0).otherwise(0.5),
        "d10": F.when(metrics.isNull(), 0.0).otherwise(_share(F.size(F.filter(goals, lambda s: s.rlike(r"\d"))), F.size(goals), 0.0)),
    }
    return {k: F.round(v, 6) for k, v in out.items()}


def gate(scores: dict[str, Column] | None = None, critical: float = 0.8, advisory: float = 0.6) -> Column:
    """REJECTED, PROVISIONAL or APPROVED from columns d1..d10; a null dimension is ignored."""
    col = lambda d: (scores or {}).get(d, F.col(d))
    bad = lambda ds, t: F.coalesce(F.least(*[F.coalesce(col(d), F.lit(1.0)) for d in ds]) < t, F.lit(False))
    return F.when(bad(CRITICAL_DIMENSIONS, critical), "REJECTED").when(bad(ADVISORY_DIMENSIONS, advisory), "PROVISIONAL").otherwise("APPROVED")


def interview(artifacts: DataFrame, key: str) -> DataFrame:
    """key, d1..d10, decision."""
    return artifacts.select(key, *[c.alias(n) for n, c in scorers(F.col("content")).items()]).withColumn("decision", gate())
