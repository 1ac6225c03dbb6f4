"""Rule-based role labels of files: additive path and content scores, and the finer relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENT = 0.5
#: Labels in the order that breaks ties.
LABELS = ["test", "documentation", "configuration", "build_tooling", "example", "vendored_dependency", "entry_point", "utility", "core_logic"]
#: Fixed values: (pattern on the lower-case path, label, points).
PATH_POINTS = [
    (r"(^|/)(tests?|specs?|__tests__)(/|$)", "test", 6),
    (r"(^|/)(test_|_test\.|\.test\.|\.spec\.)", "test", 5),
    (r"\.(md|rst|txt|adoc)$", "documentation", 5),
    (r"(^|/)docs?(/|$)", "documentation", 4),
    (r"readme|changelog|contributing|license", "documentation", 4),
    (r"\.(ya?ml|toml|ini|cfg|conf|env)$", "configuration", 5),
    (r"(^|/)(package|composer|pyproject|tsconfig|babel\.config|\.eslintrc)", "configuration", 5),
    (r"dockerfile|docker-compose", "configuration", 4),
    (r"(^|/)(scripts?|tools?|ci|\.circleci|\.github)(/|$)", "build_tooling", 4),
    (r"(^|/)(makefile|setup\.py|webpack\.config|rollup\.config|gulpfile|gruntfile)", "build_tooling", 5),
    (r"(^|/)(examples?|demos?|samples?|tutorials?)(/|$)", "example", 5),
    (r"(^|/)(vendor|third[-_]?party|external|deps)(/|$)", "vendored_dependency", 6),
    (r"(^|/)(main|index|app|server|__main__|cmd)\.(py|js|ts|go|java|rb)$", "entry_point", 4),
    (r"(^|/)(utils?|helpers?|common|shared)(/|\.py$|\.js$|\.ts$)", "utility", 4),
]
#: Patterns counted in or sought in the code.
FUNCTIONS = r"\bdef \w+\(|\bfunction \w*\(|\b\w+\s*=\s*\([^)]*\)\s*=>"
CLASSES = r"\bclass \w+"
MAIN_GUARD = r"""if __name__ == ["']__main__["']"""
CLI = r"argparse|yargs|commander|click\.command"
COMMENT_LINE = r"(?m)^\s*(#|//)"
#: Labels that only change their name.
RENAMED = {"test": "testing", "documentation": "documentation", "configuration": "configuration", "build_tooling": "build_tooling", "utility": "utility", "vendored_dependency": "vendored_dependency", "entry_point": "entry_point", "example": "example"}
#: First matching rule wins; on the path below the repository's name, any case.
PATH_RULES = [
    ("auth", r"(^|/)(auth|authentication|authorization|authn|authz|oauth|oauth2|jwt|session|sessions|login|signup|rbac|permissions?)(/|$)"),
    ("mobile", r"(^|/)(ios|android|mobile)(/|$)|Podfile|\.xcodeproj|\.xcworkspace|build\.gradle(\.kts)?|AndroidManifest\.xml|\.(swift|kt|kts|m|mm)$"),
    ("infra_devops", r"(^|/)(\.github/workflows|\.gitlab-ci|infra|terraform|k8s|kubernetes|helm|ansible|deploy|ops|iac)(/|$)|(^|/)(Dockerfile|docker-compose(\.ya?ml)?)$"),
    ("database", r"(^|/)(migrations?|schema|schemas|seeds?|orm|repositories?|dao|persistence|storage)(/|$)|\.(sql)$"),
    ("api", r"(^|/)(api|routes?|controllers?|endpoints?|graphql|rpc|rest|gateway|resolvers?)(/|$)"),
    ("ml_data", r"(^|/)(datasets?|notebooks?|training|preprocessing|features?|pipelines?|experiments?|embeddings?|rag|retrieval|evaluation|fine_tuning|feature_store|inference)(/|$)|\.(ipynb)$"),
    ("frontend", r"(^|/)(components?|pages?|views?|screens?|widgets?|layouts?|hooks?|store|stores?|assets|public|styles?|themes?|frontend|web|client|app)(/|$)|\.(jsx|tsx|vue|svelte|css|scss|less|html)$"),
    ("backend", r"(^|/)(backend|server|services?|handlers?|middleware|workers?|jobs?|consumers?|producers?|processors?)(/|$)"),
    ("utility", r"(^|/)(utils?|helpers?|common|shared|lib|libs?|constants?|types?)(/|$)"),
]
#: Content rules after the path rules.
CONTENT_RULES = [
    ("auth", r"\b(jwt|oauth2?|passport|bcrypt|authenticate|login_required|permission_classes)\b"),
    ("mobile", r"\b(UIViewController|SwiftUI|androidx\.|Activity\s*:|Fragment|ReactNative|expo-)\b"),
    ("frontend", r"\b(useState|useEffect|useMemo|useCallback|React\.Component|document\.querySelector|createElement|NextPage|defineComponent)\b"),
    ("database", r"\b(sqlalchemy|sequelize|typeorm|prisma|mongoose\.Schema|CREATE TABLE|ALTER TABLE|SELECT\s+.+\s+FROM)\b"),
    ("api", r"\b(@app\.route|APIRouter|fastapi\.|express\.Router|graphql|@RestController|@GetMapping|@PostMapping|gin\.Default|fiber\.New|\[ApiController\])\b"),
    ("infra_devops", r"\b(kubectl|docker build|apiVersion:|kind:|resource\s+\"aws_|terraform|ansible)\b"),
    ("ml_data", r"\b(torch\.nn|tensorflow|keras|sklearn|xgboost|lightgbm|pandas\.DataFrame|model\.fit\(|DataLoader|transformers\.)\b"),
    ("backend", r"\b(class .*Service|@Injectable|async def|class .*Handler|class .*Worker)\b"),
]


def path_score(path: Column, label: str) -> Column:
    out = F.lit(0.0)
    for pattern, lab, points in PATH_POINTS:
        if lab == label:
            out = out + F.when(F.lower(path).rlike(pattern), float(points)).otherwise(0.0)
    return out


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def content_score(code: Column, label: str) -> Column:
    lines = F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1
    if label == "entry_point":
        return F.when(code.rlike(MAIN_GUARD) | code.rlike(CLI), 3.0).otherwise(0.0)
    if label == "core_logic":
        return F.when(_count(code, CLASSES) >= 2, 2.0).otherwise(0.0) + 1.5  # the label of files nothing else tells
    if label == "utility":
        return F.when((_count(code, FUNCTIONS) >= 4) & (_count(code, CLASSES) == 0), 2.0).otherwise(0.0) + F.when(lines < 15, 1.0).otherwise(0.0)
    if label == "documentation":
        return F.when(_count(code, COMMENT_LINE) / lines > 0.35, 1.0).otherwise(0.0)
    return F.lit(0.0)


def classify(files: DataFrame, path: str = "filepath", code: str = "code") -> DataFrame:
    """files with predicted_label, confidence, is_confident and all_labels. Null code scores as empty text."""
    body = F.coalesce(F.col(code), F.lit(""))
    scores = [(path_score(F.col(path), lab) + content_score(body, lab)).alias(f"_{i}") for i, lab in enumerate(LABELS)]
    scored = files.select("*", *scores)
    total = sum((F.col(f"_{i}") for i in range(1, len(LABELS))), F.col("_0"))
    entries = F.array(*[F.struct((F.col(f"_{i}") / total).alias("c"), F.lit(-i).alias("tie"), F.lit(lab).alias("label")) for i, lab in enumerate(LABELS)])
    ranked = F.sort_array(entries, asc=False)
    out = scored.withColumn("_r", ranked).drop(*[f"_{i}" for i in range(len(LABELS))])
    top = F.col("_r")[0]
    kept = F.transform(F.filter("_r", lambda e: e["c"] >= CONFIDENT), lambda e: F.struct(e["label"].alias("label"), F.round(e["c"], 4).alias("confidence")))
    return out.withColumns({"predicted_label": top["label"], "confidence": F.round(top["c"], 4), "is_confident": top["c"] >= CONFIDENT, "all_labels": kept}).drop("_r")


def remap(label: Column, path: Column, content: Column) -> Column:
    """struct(label, method): the finer label of a file and how it was found. path begins with the repository's name."""
    below = F.when(path.contains("/"), F.regexp_replace(path, "^[^/]*/", "")).otherwise(path)
    out = F.when(label.isin(*RENAMED), F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv]), F.when(label.isin(*RENAMED), label).otherwise("test")).alias("label"), F.lit("direct_rename").alias("method")))
    out = out.when(label.isNull() | (label != "core_logic"), F.struct(label.alias("label"), F.lit("unknown_label_passthrough").alias("method")))
    for new, pattern in PATH_RULES:
        out = out.when(below.rlike("(?i)" + pattern), F.struct(F.lit(new).alias("label"), F.lit("path").alias("method")))
    for new, pattern in CONTENT_RULES:
        out = out.when(F.coalesce(content, F.lit("")).rlike("(?i)" + pattern), F.struct(F.lit(new).alias("label"), F.lit("content").alias("method")))
    return out.otherwise(F.struct(F.lit("backend").alias("label"), F.lit("fallback_default").alias("method")))
