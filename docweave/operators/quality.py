"""Filters, quality gates, redaction and scans. Row-level built-in expressions, and an automaton where many patterns are looked for at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..functions import urls as U

#: Texts that try to give instructions.
INJECTIONS = (
    r"(?i)\bignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above)\s+instructions?\b",
    r"(?i)\b(reveal|show|print|leak)\s+(?:the\s+)?(?:secret|credential|api\s*key|password)",
    r"(?i)\bsystem\s+message\b",
    r"(?i)\bdo\s+not\s+(?:tell|mention|disclose)",
)


def is_untrusted(text: Column) -> Column:
    found = F.lit(False)
    for p in INJECTIONS:
        found = found | F.coalesce(text, F.lit("")).rlike(p)
    return found


def detect_injection(docs: DataFrame) -> DataFrame:
    return docs.withColumn("untrusted", is_untrusted(F.col("content"))).withColumn("warning", F.when(F.col("untrusted"), "possible prompt injection"))


def quality_reason(text: Column) -> Column:
    """Why a text is quarantined, null if it is accepted: untrusted, too many replacement characters (over 1 %), control characters (over 2 %), no word character."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    control = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    replaced = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return (
        F.when(is_untrusted(t), "untrusted_content").when(replaced / n > 0.01, "excessive_replacement_characters")
        .when(control / n > 0.02, "excessive_control_characters").when(~t.rlike(r"[\p{L}\p{N}_]"), "no_word_characters")
    )


def quality_gate(docs: DataFrame) -> DataFrame:
    reason = quality_reason(F.col("content"))
    return docs.withColumn("quality_reason", reason).withColumn("quality_status", F.when(F.col("quality_reason").isNull(), "accepted").otherwise("quarantine"))


#: Keys whose values are secrets, bearer tokens, local paths.
SECRET = r"(?i)(\b(?:access[_-]?token|api[_-]?key|authorization|bearer|client[_-]?secret|password|private[_-]?key|secret|signature|token)\b\s*[:=]\s*)(?!(?:<redacted>|redacted)(?:[\s,;&?#]|$))([^\s,;&?#]+)"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
WINDOWS_PATH = r"""(?i)(?<![A-Za-z0-9])(?:[A-Z]:\\|[A-Z]:/)[^\s"']+"""
POSIX_PATH = r"""(?<![\w])/(?:Users|home|private|tmp|var|workspace)/[^\s"']+"""


def redact_text(text: Column, limit: int = 240) -> Column:
    """Secrets, bearer tokens and local paths replaced, then cut to ``limit`` characters."""
    t = F.regexp_replace(text, SECRET, "$1<redacted>")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, BEARER, "Bearer <redacted>"), WINDOWS_PATH, "<local-path>"), POSIX_PATH, "<local-path>")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, max(0, limit - 3)), F.lit("..."))).otherwise(t)


#: Field names by what happens to them in reports.
CONTENT_FIELDS, CORPUS_FIELDS, QUERY_FIELDS = frozenset("content text raw stdout stderr".split()), frozenset("corpus document_text document_content".split()), frozenset(["query"])
MESSAGE_FIELDS = frozenset("message reason detail hint error path source_path directory documents_dir data_dir models_cache_dir cwd source url uri command".split())
#: Fields that must not leave (exact names).
SENSITIVE_FIELDS = frozenset("token secret password credential query content text prompt command script shell".split())


def _redacted(c: Column, kind: S.DataType, name: str) -> Column:
    low = name.lower()
    text = isinstance(kind, S.StringType)
    if text and low in CONTENT_FIELDS:
        return F.when(c.isNotNull(), "<redacted-content>")
    if text and low in CORPUS_FIELDS:
        return F.when(c.isNotNull(), "<redacted-corpus>")
    if low in QUERY_FIELDS:
        return F.when(c.isNotNull(), "<redacted-query>")
    if isinstance(kind, S.StructType):
        return F.when(c.isNotNull(), F.struct(*[_redacted(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, S.ArrayType):
        return F.transform(c, lambda x: _redacted(x, kind.elementType, ""))
    return redact_text(c) if text else c


def redact_columns(df: DataFrame) -> DataFrame:
    """Redact by field name at any depth: the schema is walked once on the driver, the result is one projection."""
    return df.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def drop_sensitive_fields(df: DataFrame, names: frozenset = SENSITIVE_FIELDS) -> DataFrame:
    """The same table without sensitive fields at any depth of structs and arrays of structs."""

    def build(c: Column, kind: S.DataType) -> Column:
        if isinstance(kind, S.StructType):
            kept = [build(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name.lower() not in names]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(kind, S.ArrayType) and isinstance(kind.elementType, S.StructType):
            return F.transform(c, lambda x: build(x, kind.elementType))
        return c

    return df.select(*[build(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name.lower() not in names])


def sensitive_fields(schema: S.StructType, names: frozenset = SENSITIVE_FIELDS, at: str = "") -> list[str]:
    """Paths of the sensitive fields of a schema."""
    out = []
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, S.ArrayType) else f.dataType
        if f.name.lower() in names:
            out.append(at + f.name)
        if isinstance(kind, S.StructType):
            out += sensitive_fields(kind, names, f"{at}{f.name}.")
    return out


def _present(schema: S.StructType, names: frozenset, at: str, get: Callable[..., Column]) -> list[tuple[str, Column]]:
    """(path, whether a row holds a value there) of the sensitive fields of a struct whose fields ``get`` gives."""
    out = []
    for f in schema.fields:
        value, kind = get(f.name), f.dataType
        if f.name.lower() in names:
            out.append((at + f.name, value.isNotNull()))
        if isinstance(kind, S.StructType):
            out += _present(kind, names, f"{at}{f.name}.", value.getField)
        elif isinstance(kind, S.ArrayType) and isinstance(kind.elementType, S.StructType):
            for path in sensitive_fields(kind.elementType, names):
                out.append((f"{at}{f.name}.{path}", F.exists(value, _holds(kind.elementType, names, path))))
    return out


def _holds(kind: S.StructType, names: frozenset, path: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(dict(_present(kind, names, "", x.getField))[path], F.lit(False))


def sensitive_findings(df: DataFrame, key: str) -> DataFrame:
    """key, field: one row for each sensitive field that a row holds a value in, at any depth of structs and arrays of structs. A table without findings may be taken as it is; the schema is walked once on the driver."""
    found = _present(df.schema, SENSITIVE_FIELDS, "", lambda name: F.col(f"`{name}`"))
    paths = F.array_compact(F.array(*[F.when(held, F.lit(path)) for path, held in found])) if found else F.array().cast("array<string>")
    return df.select(F.col(f"`{key}`").alias(key), F.explode(paths).alias("field"))


#: Credentials as they stand in texts.
CREDENTIALS = (
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    r"""(?i)["']?(?:bearer[_ -]?token|access[_ -]?token|refresh[_ -]?token|api[_ -]?key|client[_ -]?secret|private[_ -]?key)["']?\s*[:=]\s*["']?(?!replace(?:\b|[_-])|<set|\$\{|your[_ -]?|change[_ -]?me|example\b|placeholder\b)[A-Za-z0-9][A-Za-z0-9_./+=:@-]{19,}""",
    r"""(?i)\b(?:api[_ -]?key|secret|password|token)\s*[:=]\s*["']?(?!REPLACE|<set|\$\{)[A-Za-z0-9_./+=-]{20,}""",
)
#: Of each pattern what a text holds, in lower case, if the pattern is to have a chance.
STEMS = (("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("akia",), ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), ("token", "key", "secret"), ("key", "secret", "password", "token"))


def _chances(docs: DataFrame) -> DataFrame:
    """path, content, mask of the documents that hold a stem: bit i stands for pattern i + 1. One automaton of all stems reads each text once; texts without any (nearly all) end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, int] = {}
        for i, some in enumerate(STEMS):
            for stem in some:
                stems[stem] = stems.get(stem, 0) | 1 << i
        automaton = ahocorasick.Automaton()
        for stem, mask in stems.items():
            automaton.add_word(stem, mask)
        automaton.make_automaton()
        for b in batches:
            rows, masks = [], []
            for i, text in enumerate(b.column(1)):
                mask = 0
                for _, m in automaton.iter((text.as_py() or "").lower()):
                    mask |= m
                if mask:
                    rows.append(i)
                    masks.append(mask)
            kept = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(masks, pa.int32())], ["path", "content", "mask"])

    return docs.select("path", "content").mapInArrow(run, "path string, content string, mask int")


def secret_scan(docs: DataFrame) -> DataFrame:
    """path, pattern (from 1): the first credential pattern that a document holds; documents without one are left out. The patterns themselves are tested only where an automaton has seen one of their stems."""
    first = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(CREDENTIALS))):
        first = F.when((F.col("mask").bitwiseAND(1 << i) != 0) & F.col("content").rlike(p), i + 1).otherwise(first)
    return _chances(docs).select("path", first.alias("pattern")).where("pattern IS NOT NULL")


HOME_PATH = r"""(?:[A-Za-z]:[\\/]+Users[\\/]+[^\s`"']+|/Users/[^\s`"']+|/home/[^\s`"']+)"""
#: Parts of a path that show it is an example.
PLACEHOLDERS = ("seu_usuario", "your_user", "yourname", "user", "username", "you")


def author_path_scan(docs: DataFrame) -> DataFrame:
    """path, found: absolute paths of home folders without a placeholder part."""
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(HOME_PATH), F.lit(0))
    real = F.filter(found, lambda x: ~F.arrays_overlap(F.split(F.lower(x), r"[\\/]+"), F.array(*map(F.lit, PLACEHOLDERS))))
    return docs.select("path", F.explode(real).alias("found"))


#: Folders that hold run-time data or build results, and private configuration files.
RUNTIME_FOLDERS = (".venv", ".venv-rag", ".venv-posix", ".venv-windows", ".ruff_cache", "data", "models_cache", "artifacts", "build", "dist", ".scratch")
NETWORK_FILES = ("network.yaml", "network.yml", "network.json", "network.toml")


def path_prohibition(paths: DataFrame, vendored: str | None = None) -> DataFrame:
    """path, size, code: why a file may not be released (null: it may). Files below the folder ``vendored`` may lie in a data folder."""
    parts = F.split(F.lower("path"), "/")
    vendor = F.lower("path").startswith(vendored) if vendored else F.lit(False)
    allowed = (parts[0] == "documents") & F.try_element_at(parts, F.lit(2)).isin("readme.md", "examples", "fixtures")
    code = (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, RUNTIME_FOLDERS))) & ~vendor, "prohibited_runtime")
        .when(F.array_contains(parts, ".rag_state.json"), "prohibited_state")
        .when(F.array_contains(parts, "documents") & ~F.coalesce(allowed, F.lit(False)), "prohibited_corpus")
        .when(F.element_at(parts, -1).isin(*NETWORK_FILES), "prohibited_network_configuration")
        .when(F.col("size") > 25 * 1024 * 1024, "large_artifact")
    )
    return paths.select("path", "size", code.alias("code"))


MOJIBAKE = "(?:Ã[\u0080-¿]|Â[\u0080-¿]|â.{0,2}[\u0080-\u009f]|�)"


def mojibake_scan(docs: DataFrame) -> DataFrame:
    """path, found, n of documents with the marks of wrong decoding."""
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(MOJIBAKE), F.lit(0))
    return docs.select("path", F.try_element_at(found, F.lit(1)).alias("found"), F.size(found).alias("n")).where("n > 0")


def unpinned_requirements(files: DataFrame) -> DataFrame:
    """path, line (from 1), requirement: requirement lines without an exact version; comments and options are skipped."""
    rows = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line"), F.trim("raw").alias("requirement"))
    return rows.where(~F.col("requirement").rlike("^$|^[#-]") & ~F.contains("requirement", F.lit("==")))


def crawl_skip_reason(urls: DataFrame, start_host: str, same_host: bool = True, include: tuple = (), exclude: tuple = (), disallow: tuple = ()) -> DataFrame:
    """url, reason: the first reason to skip a URL, null to visit it. Patterns are shell patterns (``re:`` before regular expressions), compiled on the driver; disallow lists path beginnings."""
    import fnmatch

    u = U.Url(F.col("url"))
    target = F.when(u.query == "", u.path).otherwise(F.concat(u.path, F.lit("?"), u.query))

    def hits(patterns: tuple) -> Column:
        any_ = F.lit(False)
        for p in patterns:
            if p.startswith("re:"):
                any_ = any_ | F.col("url").rlike(p[3:])
            else:
                full = "^(?:" + fnmatch.translate(p).replace("(?s:", "(?s)(?:").replace(r"\Z", "").replace(r"\z", "") + ")$"
                any_ = any_ | F.col("url").rlike(full) | u.path.rlike(full) | target.rlike(full)
        return any_

    robots = F.lit(False)
    for p in disallow:
        robots = robots | target.startswith(p)
    reason = F.when(~u.is_http, "non-http-url").when(U.is_asset(F.col("url")), "asset").when(robots, "robots-disallow")
    if same_host:
        reason = reason.when(u.host != start_host.lower(), "external-host")
    if include:
        reason = reason.when(~hits(include), "outside-include")
    return urls.withColumn("reason", reason.when(hits(exclude), "excluded"))


def classify_diagnostic(lines: DataFrame) -> DataFrame:
    """code, severity, category, length of diagnostic lines (column line); their text is not kept."""
    value = redact_text(F.coalesce("line", F.lit("")), 4096)
    up = F.upper(value)
    has = lambda *words: up.rlike("|".join(words))
    code = F.when(has("ERROR", "EXCEPTION", "FAIL"), "stderr_error").when(has("WARN"), "stderr_warning").when(has("TIMEOUT"), "stderr_timeout").otherwise("stderr_event")
    severity = F.when(code == "stderr_error", "error").when(code == "stderr_event", "info").otherwise("warning")
    category = F.when(has("MCP", "JSON-RPC", "STDOUT", "STDERR"), "protocol").otherwise("backend")
    return lines.withColumns({"code": code, "severity": severity, "category": category, "length": F.least(F.length(value), F.lit(4096))}).drop("line")


def golden_validate(cases: DataFrame) -> DataFrame:
    """set_id, case_id, code of every fault of golden cases (set_id, case_id, query, expected_filepath, kind, expected_route, reviewed)."""
    path = F.replace(F.coalesce("expected_filepath", F.lit("")), F.lit("\\"), F.lit("/"))
    kind = F.coalesce("kind", F.lit("factual"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    faults = [
        (blank("case_id"), "golden_case_id"),
        (blank("query") | (blank("expected_filepath") & (kind != "router")), "golden_case_fields"),
        (path.startswith("/") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), ".."), "golden_case_path"),
        (~kind.isin("conceptual", "factual", "router"), "golden_case_kind"),
        ((kind == "router") & ~F.coalesce(F.col("expected_route"), F.lit("")).isin("skill", "rag", "both", "lifecycle"), "golden_case_route"),
        (~F.coalesce("reviewed", F.lit(False)), "golden_case_not_reviewed"),
    ]
    codes = F.array_compact(F.array(*[F.when(c, code) for c, code in faults]))
    return cases.select("set_id", "case_id", F.explode(codes).alias("code"))


def golden_reviewed(sets: DataFrame, cases: DataFrame) -> DataFrame:
    """set_id, reviewed, n_cases, n_faults: a set counts as reviewed if it says so, has cases and none has a fault."""
    n = cases.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_cases"))
    bad = golden_validate(cases).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_faults"))
    all_ = sets.join(n, "set_id", "left").join(bad, "set_id", "left").withColumns({"n_cases": F.coalesce("n_cases", F.lit(0)), "n_faults": F.coalesce("n_faults", F.lit(0))})
    return all_.select("set_id", (F.col("reviewed") & (F.col("n_cases") > 0) & (F.col("n_faults") == 0)).alias("reviewed"), "n_cases", "n_faults")


def license_gate(sources: DataFrame) -> DataFrame:
    """warning and error of sources by license and the redistribution that is asked for (license, redistribution)."""
    unknown = F.coalesce("license", F.lit("unknown")) == "unknown"
    return sources.withColumns({"warning": F.when(unknown, "private-only"), "error": F.when(unknown & (F.col("redistribution") == "public"), "license_required")})
