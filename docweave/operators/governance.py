"""Governance: registry, rights, claims, conflicts, revocations, resolution of names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T

#: Purposes of use, kinds of claims and their priority, authority classes.
PURPOSES = ("acquisition", "storage", "indexing", "internal_query", "quotation", "derivatives", "redistribution")
PRIORITY = {"official_rule": 5, "factual_observation": 4, "recommendation": 3, "experience": 2, "opinion": 1, "hypothesis": 1}
AUTHORITY = ("official", "research", "practitioner", "community", "unknown")
SOURCE_TYPES = ("official_documentation", "policy", "article", "study", "experiment", "video_transcript", "other", "unknown")
NO_POLICY = ("", "unknown", "unspecified")


# --- rights ---------------------------------------------------------------------------------------------------------


def normalize_grants(grants: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a source and purpose: decision, validity, regions, issues.

    grants: (source_id, position, purpose, decision, evidence_ref, actor, valid_from, valid_until, review_after, regions). capture means acquisition; the last grant of a purpose wins; ``allowed`` without
    evidence, actor, or an end or review date becomes unknown, with its issues. Purposes without grant are unknown.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    allowed = F.col("decision") == "allowed"
    issues = F.array_compact(F.array(
        F.when(allowed & blank("evidence_ref"), "allowed_requires_evidence_ref"), F.when(allowed & blank("actor"), "allowed_requires_actor"),
        F.when(allowed & F.col("valid_until").isNull() & F.col("review_after").isNull(), "allowed_requires_expiry_or_review"),
    ))
    g = grants.withColumns({"purpose": F.when(F.col("purpose") == "capture", "acquisition").otherwise(F.col("purpose")), "issues": issues})
    g = g.withColumn("decision", F.when(F.size("issues") > 0, "unknown").otherwise(F.coalesce("decision", F.lit("unknown"))))
    kept = ["decision", "valid_from", "valid_until", "review_after", "regions", "issues"]
    last = g.groupBy("source_id", "purpose").agg(F.max_by(F.struct(*kept), "position").alias("g")).select("source_id", "purpose", "g.*")
    every = sources.select("source_id").distinct().select("source_id", F.explode(F.array(*map(F.lit, PURPOSES))).alias("purpose"))
    out = every.join(last, ["source_id", "purpose"], "left")
    return out.withColumns({"decision": F.coalesce("decision", F.lit("unknown")), "issues": F.coalesce("issues", F.array().cast("array<string>")), "regions": F.coalesce("regions", F.array().cast("array<string>"))})


def use_decision(sources: DataFrame, governance: DataFrame, registry: DataFrame, grants: DataFrame, revocations: DataFrame, as_of: Column, region: str | None = None, purposes: tuple = PURPOSES) -> DataFrame:
    """source_id, purpose, allowed, code, reason: the first rule that holds decides.

    governance: (source_id, lifecycle, valid_from, valid_until, privacy, retention_until, observed_revision); registry: (source_id, status); grants as from normalize_grants; revocations: (source_id).
    The purposes are a fixed list that is exploded, so no cross join; everything else are joins on source_id.
    """
    ids = sources.select("source_id").distinct().select("source_id", F.explode(F.array(*map(F.lit, purposes))).alias("purpose"))
    g = governance.select("source_id", "lifecycle", F.col("valid_from").alias("source_from"), F.col("valid_until").alias("source_until"), "privacy", "retention_until", F.lit(True).alias("known"))
    d = ids.join(g, "source_id", "left").join(registry.select("source_id", F.col("status").alias("registry_status")), "source_id", "left")
    d = d.join(revocations.select("source_id").distinct().withColumn("revoked", F.lit(True)), "source_id", "left").join(grants, ["source_id", "purpose"], "left")
    wrong_region = F.lit(False)
    if region is not None:
        wrong_region = (F.size(F.coalesce("regions", F.array().cast("array<string>"))) > 0) & ~F.array_contains("regions", region)
    late = lambda c: F.coalesce(as_of >= F.col(c), F.lit(False))
    rules = [
        (~F.col("purpose").isin(*PURPOSES), "INVALID_INPUT", None),
        (F.col("known").isNull(), "RIGHTS_BLOCKED", "governance_unknown"),
        (F.coalesce("registry_status", F.lit("active")).isin("withdrawn", "revoked", "archived", "inactive"), "SOURCE_REVOKED", "registry_source_inactive"),
        (F.coalesce("revoked", F.lit(False)), "SOURCE_REVOKED", "source_revoked"),
        (F.coalesce("lifecycle", F.lit("active")) == "revoked", "SOURCE_REVOKED", "source_revoked"),
        ((F.coalesce("lifecycle", F.lit("active")) == "archived") & F.col("purpose").isin("indexing", "internal_query", "quotation", "derivatives", "redistribution"), "SOURCE_ARCHIVED", "source_archived"),
        (~R.validity_active(F.col("source_from"), F.col("source_until"), as_of), "EVIDENCE_STALE", "source_validity_inactive"),
        (F.coalesce("decision", F.lit("unknown")) != "allowed", "RIGHTS_BLOCKED", "grant_unknown_or_denied"),
        (F.coalesce(as_of < F.col("valid_from"), F.lit(False)), "RIGHTS_BLOCKED", "grant_not_yet_valid"),
        (late("valid_until"), "RIGHTS_BLOCKED", "grant_expired"),
        (late("review_after"), "RIGHTS_BLOCKED", "grant_review_due"),
        (wrong_region, "RIGHTS_BLOCKED", "region_not_allowed"),
        ((F.coalesce("privacy", F.lit("unknown")) == "unknown") & F.col("purpose").isin("storage", "indexing", "redistribution"), "PRIVACY_BLOCKED", "privacy_unknown"),
        (late("retention_until"), "PRIVACY_BLOCKED", "retention_expired"),
    ]
    code, reason = F.lit("ALLOWED"), F.lit(None).cast("string")
    for condition, c, r in reversed(rules):
        code, reason = F.when(condition, c).otherwise(code), F.when(condition, F.lit(r).cast("string")).otherwise(reason)
    return d.select("source_id", "purpose", (code == "ALLOWED").alias("allowed"), code.alias("code"), reason.alias("reason"))


def normalize_governance(raw: DataFrame) -> DataFrame:
    """source_id, error: the first fault of a governance record (null: accepted): unknown enumeration values, date text against its precision, ends before starts."""
    n = F.length("published_at")
    error = (
        F.when(F.coalesce(F.trim("source_id"), F.lit("")) == "", "source_id")
        .when(~F.coalesce("source_type", F.lit("unknown")).isin(*SOURCE_TYPES), "source_type")
        .when(~F.coalesce("published_precision", F.lit("unknown")).isin("unknown", "date", "timestamp"), "published_precision")
        .when((F.coalesce("published_precision", F.lit("unknown")) == "unknown") & F.col("published_at").isNotNull(), "published_at")
        .when((F.col("published_precision") == "date") & (n != 10), "published_at").when((F.col("published_precision") == "timestamp") & (n == 10), "published_at")
        .when(F.col("valid_until") < F.col("valid_from"), "validity.until")
        .when(~F.coalesce("privacy", F.lit("unknown")).isin("public", "internal", "restricted", "unknown"), "privacy.classification")
        .when(~F.coalesce("lifecycle", F.lit("active")).isin("active", "archived", "revoked"), "lifecycle")
        .when(~F.coalesce("authority_class", F.lit("unknown")).isin(*AUTHORITY), "authority_class")
    )
    return raw.select("source_id", error.alias("error"))


# --- registry -------------------------------------------------------------------------------------------------------


def register_sources(registry: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, code, and the registration that holds afterwards: upsert by source_id.

    A source that is bound to another canonical, kind, scope or version policy is a source_conflict; a withdrawn one needs readmit, and then rights, privacy, authority and owner. Two sources may share a canonical URL.
    """
    fields = ["canonical", "kind", "scope", "version_policy", "rights", "privacy", "authority", "owner"]
    o = registry.select("source_id", "status", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_old"))
    n = new.select("source_id", "readmit", *fields, F.lit(True).alias("_new"))
    both = o.join(n, "source_id", "full_outer")
    differs = reduce(lambda a, f: a | ~F.col(f).eqNullSafe(F.col(f"_{f}")), fields[:4], F.lit(False))
    open_policy = reduce(lambda a, f: a | F.lower(F.trim(F.coalesce(f, F.lit("")))).isin(*NO_POLICY), fields[4:], F.lit(False))
    withdrawn = F.col("status") == "withdrawn"
    code = (
        F.when(F.col("_new").isNull(), "unchanged").when(F.col("_old").isNull(), "source_registered").when(differs, "source_conflict")
        .when(withdrawn & ~F.coalesce("readmit", F.lit(False)), "source_readmission_required").when(withdrawn & open_policy, "source_not_admitted").otherwise("source_registered")
    )
    both = both.withColumn("code", code)
    took = F.col("code") == "source_registered"
    return both.select("source_id", "code", F.when(took, "active").otherwise(F.col("status")).alias("status"), *[F.when(took, F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in fields])


def reconcile_sources(registry: DataFrame, snapshots: DataFrame) -> DataFrame:
    """source_id, code, status, version of the latest observation (source_id, seq, observation_time, scope, completeness, version, n_entries, withdraw) of each source; the first rule that holds decides.

    Anything but a complete observation leaves the source as it is; an empty one withdraws only when asked to.
    """
    latest = snapshots.groupBy("source_id").agg(F.max_by(F.struct("scope", "completeness", "version", "n_entries", "withdraw"), F.struct("observation_time", "seq")).alias("s")).select("source_id", F.col("s.scope").alias("seen_scope"), "s.completeness", F.col("s.version").alias("seen_version"), "s.n_entries", "s.withdraw")
    r = latest.join(registry.withColumn("_known", F.lit(True)), "source_id", "left")
    open_policy = reduce(lambda a, f: a | F.lower(F.trim(F.coalesce(f, F.lit("")))).isin(*NO_POLICY), ["rights", "privacy", "authority", "owner"], F.lit(False))
    withdraw = F.coalesce("withdraw", F.lit(False))
    code = (
        F.when(F.col("_known").isNull(), "source_not_registered").when(F.col("status") == "withdrawn", "source_withdrawn_before").when(open_policy, "source_not_admitted")
        .when(F.col("seen_scope") != F.col("scope"), "scope_mismatch").when(F.col("completeness") != "complete", "acquisition_incomplete")
        .when((F.col("version_policy") == "pinned") & F.col("seen_version").isNotNull() & ~F.col("seen_version").eqNullSafe(F.col("version")), "version_pinned")
        .when((F.col("n_entries") == 0) & ~withdraw, "withdrawal_confirmation_required").when(withdraw, "source_withdrawn").otherwise("source_reconciled")
    )
    r = r.withColumn("code", code)
    done = F.col("code").isin("source_withdrawn", "source_reconciled")
    version = F.when(done & (F.col("version_policy") == "latest") & F.col("seen_version").isNotNull(), F.col("seen_version")).otherwise(F.col("version"))
    return r.select("source_id", "code", F.when(F.col("code") == "source_withdrawn", "withdrawn").otherwise(F.col("status")).alias("status"), version.alias("version"))


# --- names ----------------------------------------------------------------------------------------------------------


def resolve_sources(queries: DataFrame, catalog: DataFrame, delta: float = 0.05) -> DataFrame:
    """query_id, slug, status (resolved, requires_decision, not_official, source_not_found) and the number of candidates.

    catalog: (slug, aliases, official, confidence). Names meet over their normal form; with several candidates the first must lead by more than ``delta``. A query_id that comes with several queries has the candidates of all.

    Every set of names that is asked for is settled once, by aggregates over its candidates; queries only look their set up, so no row stands for a (query, candidate) pair.
    """
    asked = queries.groupBy("query_id").agg(F.array_sort(F.collect_set(T.normalise_name(F.col("query")))).alias("names"))
    sets = asked.select("names").distinct().select("names", F.explode("names").alias("name"))
    all_names = F.array_distinct(F.transform(F.concat(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>"))), T.normalise_name))
    hit = catalog.select("slug", "official", "confidence", F.explode(all_names).alias("name")).join(sets, "name").select("names", "slug", "official", "confidence").distinct()
    levels = hit.groupBy("names", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("slug", "official")).alias("first"))
    top = levels.groupBy("names").agg(F.max(F.struct("confidence", "n", "first")).alias("top"), F.sum("n").alias("candidates"))
    # a null confidence comes last, as a level of its own
    lower = levels.join(top.select("names", F.col("top.confidence").alias("_best")), "names").where("confidence < _best").groupBy("names").agg(F.max("confidence").alias("lower"))
    ranked = top.join(lower, "names", "left").select("names", F.col("top.first.slug").alias("slug"), F.col("top.first.official").alias("official"), F.col("top.confidence").alias("confidence"), F.when(F.col("top.n") > 1, F.col("top.confidence")).otherwise(F.col("lower")).alias("next"), "candidates")
    out = queries.select("query_id").join(asked.join(ranked, "names"), "query_id", "left")
    close = F.coalesce(F.round(F.col("confidence") - F.col("next"), 9) <= delta, F.lit(False))
    status = F.when(F.col("slug").isNull(), "source_not_found").when(close, "requires_decision").when(~F.coalesce("official", F.lit(False)), "not_official").otherwise("resolved")
    return out.select("query_id", F.when(~close, F.col("slug")).alias("slug"), status.alias("status"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


#: Name providers: names (query_id, query) -> candidates (query_id, slug, official, confidence). Users add their own.
RESOLVERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_resolver(name: str, resolve: Callable[[DataFrame], DataFrame]) -> None:
    RESOLVERS[name] = resolve


#: About how many query_ids with the same set of queries stand in one list, and in how many parts a set's candidates meet each list.
TAKERS = 1000
PARTS = 32


def resolve_with(names: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """query_id, provider, slug, official, confidence, rank: the distinct candidates of all providers, best first. A query_id that comes with several queries has the candidates of all.

    Providers are asked, and candidates ranked, once for each distinct set of queries of a query_id, under the smallest query_id that has it; at the end every query_id that has it takes over those rows. To that end its
    query_ids stand in lists of about ``TAKERS``, and candidates meet lists by set, list and part: a set that many ask for is dealt to all tasks whichever join is taken, a row is shuffled for each (candidate, list), and
    those of its query_ids are written out where they meet.
    """
    asked = names.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("query"))).alias("queries"))
    sets = asked.groupBy("queries").agg(F.min("query_id").alias("query_id"), F.ceil(F.count(F.lit(1)) / TAKERS).alias("_lists"))
    once = sets.select("query_id", F.explode("queries.query").alias("query"))
    parts = [RESOLVERS[p](once).select("query_id", "slug", "official", "confidence").withColumn("provider", F.lit(p)) for p in providers or sorted(RESOLVERS)]
    # the smallest query_id may be null, a struct of it is not
    own = F.struct("query_id").alias("_set")
    all_ = reduce(DataFrame.unionByName, parts).groupBy(own, "slug", "official", "confidence").agg(F.min("provider").alias("provider"))
    ranked = all_.withColumn("rank", F.row_number().over(Window.partitionBy("_set").orderBy(F.col("confidence").desc(), "slug")))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    ranked = ranked.join(sets.select(own, "_lists"), "_set").select("*", up_to(F.col("_lists")).alias("_list"), F.pmod("rank", F.lit(PARTS)).cast("long").alias("_part")).drop("_lists")
    of = asked.join(sets.select("queries", own, "_lists"), "queries").select("query_id", "_set", F.pmod(F.xxhash64("query_id"), "_lists").alias("_list"))
    lists = of.groupBy("_set", "_list").agg(F.collect_list(F.struct("query_id")).alias("ids"))  # of structs, as a list drops nulls
    lists = lists.select("_set", "_list", F.transform("ids", lambda x: x["query_id"]).alias("ids"), up_to(F.lit(PARTS).cast("long")).alias("_part"))
    key = ["_part", "_list", "_set"]
    spread = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = ranked.repartition(spread, *key).join(lists.repartition(spread, *key), key)
    return met.select(F.explode("ids").alias("query_id"), "provider", "slug", "official", "confidence", "rank")


# --- claims ---------------------------------------------------------------------------------------------------------


def normalize_claims(raw: DataFrame) -> DataFrame:
    """claim_id, error, and the fields of the last record of each claim (by position). error names the first fault, null: accepted."""
    last = raw.groupBy("claim_id").agg(F.max_by(F.struct("text", "classification", "review_status", "reviewer_ref", "evidence_refs"), "position").alias("c")).select("claim_id", "c.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    refs = F.coalesce("evidence_refs", F.array().cast(raw.schema["evidence_refs"].dataType))

    def bad(ref):
        times = ref["locator_kind"] == "timestamp"
        start, end = R.timestamp_ms(ref["locator_value"]), R.timestamp_ms(ref["locator_end"])
        return (
            blank(ref["source_id"]) | blank(ref["observed_revision"]) | blank(ref["document_id"]) | ~F.coalesce(ref["content_hash"].rlike("^[0-9a-f]{64}$"), F.lit(False))
            | ~F.coalesce(ref["locator_kind"], F.lit("")).isin("section", "page", "timestamp", "line") | blank(ref["locator_value"]) | (times & ~F.coalesce(end > start, F.lit(False)))
        )

    error = (
        F.when(blank("text") | ~F.coalesce("classification", F.lit("")).isin(*PRIORITY), "text_and_classification_required").when(F.exists(refs, bad), "evidence_invalid")
        .when(~F.coalesce("review_status", F.lit("proposed")).isin("proposed", "reviewed"), "review_status_invalid").when((F.col("review_status") == "reviewed") & blank("reviewer_ref"), "reviewer_required")
        .when((F.col("classification") == "official_rule") & (F.size(refs) == 0), "official_rule_requires_evidence")
    )
    return last.select("claim_id", error.alias("error"), "text", "classification", F.coalesce("review_status", F.lit("proposed")).alias("review_status"), F.size(refs).alias("n_refs"))


def link_conflicts(conflicts: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conflicts with error, claims with conflict_ids): a conflict needs two distinct known claims, a valid relation, and for ``resolved`` a resolution and a reviewer; accepted ones are added to their claims."""
    c = conflicts.withColumn("claim_ids", F.array_distinct("claim_ids"))
    known = c.select("conflict_id", F.explode("claim_ids").alias("claim_id")).join(claims.select("claim_id"), "claim_id", "left_semi").groupBy("conflict_id").agg(F.count(F.lit(1)).alias("n_known"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    c = c.join(known, "conflict_id", "left")
    error = (
        F.when((F.size("claim_ids") < 2) | ~F.coalesce("relation", F.lit("")).isin("contradicts", "supersedes", "scope_difference"), "two_claims_and_relation_required")
        .when(~F.coalesce("status", F.lit("open")).isin("open", "resolved"), "status_invalid").when((F.col("status") == "resolved") & (blank("resolution") | blank("reviewer_ref")), "resolution_required")
        .when(F.coalesce("n_known", F.lit(0)) < F.size("claim_ids"), "unknown_claim")
    )
    checked = c.withColumn("error", error).drop("n_known")
    added = checked.where("error IS NULL").select(F.explode("claim_ids").alias("claim_id"), "conflict_id").groupBy("claim_id").agg(F.array_sort(F.collect_set("conflict_id")).alias("_added"))
    linked = claims.join(added, "claim_id", "left")
    none = F.array().cast("array<string>")
    return checked, linked.withColumn("conflict_ids", F.array_union(F.coalesce("conflict_ids", none), F.coalesce("_added", none))).drop("_added")


def eligible_claims(claims: DataFrame, refs: DataFrame, sources: DataFrame, decisions: DataFrame, as_of: Column, region: str | None = None, claim_type: str | None = None, source_kind: str | None = None, authority: str | None = None, published_from: str | None = None, published_until: str | None = None) -> DataFrame:
    """The claims that may be used: valid at ``as_of`` and backed by at least one reference to an allowed source that meets the filters (a semi join, so claims without references drop out).

    claims: (claim_id, classification, region, valid_from, valid_until, ...); refs: (claim_id, source_id, observed_revision); sources: (source_id, observed_revision, source_type, authority_class, published_at as text);
    decisions as from use_decision. The source side is reduced to a row a source before it meets the references.
    """
    c = claims.where(R.validity_active(F.col("valid_from"), F.col("valid_until"), as_of))
    if claim_type is not None:
        c = c.where(F.col("classification") == claim_type)
    if region is not None:
        c = c.where(F.col("region").isNull() | (F.col("region") == region))
    s = sources.join(decisions.where("allowed AND purpose = 'internal_query'").select("source_id"), "source_id", "left_semi")
    for column, wanted in (("source_type", source_kind), ("authority_class", authority)):
        if wanted is not None:
            s = s.where(F.col(column) == wanted)
    if published_from is not None:
        s = s.where(F.col("published_at") >= published_from)
    if published_until is not None:
        s = s.where(F.col("published_at") <= published_until)
    good = refs.join(s.select("source_id", F.col("observed_revision").alias("_now")), "source_id").where("observed_revision IS NULL OR _now IS NULL OR observed_revision = _now")
    return c.join(good.select("claim_id"), "claim_id", "left_semi")


def open_conflicts(conflicts: DataFrame, selected: DataFrame) -> DataFrame:
    """conflict_id, hits: open conflicts of which at least two claims are selected (claim_id)."""
    c = conflicts.where("status = 'open'").select("conflict_id", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    return c.join(selected.select("claim_id").distinct(), "claim_id").groupBy("conflict_id").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 2")


def claim_priority(classification: Column) -> Column:
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(classification == name, value).otherwise(out)
    return out


def query_evidence(queries: DataFrame, claims: DataFrame, refs: DataFrame, conflicts: DataFrame, hits: DataFrame, decisions: DataFrame, max_results: int = 5) -> DataFrame:
    """query_id, kind (claim, evidence, result, outcome), position, item: what governed retrieval gives for each query.

    claims (eligible ones) must share a word with the query; they come by priority of their class, then id. hits: (query_id, source, source_id, rank, locators array of struct<kind, label>) count only
    with a source that may be used; each adds up to three references. Evidence is cut at three times max_results. The outcome is conflicting, supported or insufficient_evidence.

    Claims are matched, ordered and cut once for each set of words that is asked for, under the smallest query_id that has it; the outcome reads no references of claims, as a claim alone supports.
    """
    words = T.claim_words(F.col("query"))
    own = queries.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("words"), F.bool_or(F.size(words) == 0).alias("wordless"))
    sets = own.groupBy("words", "wordless").agg(F.min("query_id").alias("set_id"))
    of = own.join(sets, ["words", "wordless"]).select("query_id", "set_id")
    cw = claims.select("claim_id", "classification", F.explode(T.claim_words(F.col("text"))).alias("w"))
    matched = cw.join(sets.where("NOT wordless").select("set_id", F.explode("words").alias("w")), "w").select("set_id", "claim_id", "classification").distinct()
    wordless = sets.where("wordless").select("set_id").join(claims.select("claim_id", "classification"), F.lit(True))
    matched = matched.unionByName(wordless)
    low = -claim_priority(F.col("classification"))
    first = F.row_number().over(Window.partitionBy("set_id").orderBy(low, "claim_id"))
    ranked = matched.withColumn("position", first).where(F.col("position") <= max_results).join(of, "set_id")
    k = conflicts.where("status = 'open'").select("conflict_id", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    conflicting = k.join(matched, "claim_id").groupBy("set_id", "conflict_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("set_id").distinct().join(of, "set_id").select("query_id", F.lit(True).alias("conflicting"))
    ok = hits.join(decisions.where("allowed AND purpose = 'internal_query'").select("source_id"), "source_id", "left_semi")
    # what claims refer to comes before what hits do, so of a set's references no more than can be given are needed
    claim_refs = matched.select("set_id", F.struct(low.alias("low"), "claim_id").alias("o"), "claim_id").join(refs.select("claim_id", "source_id", "document_id"), "claim_id").groupBy("set_id", F.concat_ws("|", "source_id", "document_id").alias("item")).agg(F.min("o").alias("o"))
    claim_refs = claim_refs.withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("o", "item"))).where(F.col("rank") <= 3 * max_results)
    claim_refs = claim_refs.join(of, "set_id").select("query_id", F.lit(0).alias("from_hit"), "rank", F.lit(0).alias("nth"), "item")
    hit_refs = ok.select("query_id", F.lit(1).alias("from_hit"), F.col("rank"), F.posexplode(F.slice("locators", 1, 3)).alias("nth", "l"), "source_id", "source")
    hit_refs = hit_refs.where("trim(l.label) <> ''").select("query_id", "from_hit", "rank", "nth", F.concat_ws("|", "source_id", "source", F.col("l.kind"), F.col("l.label")).alias("item"))
    evidence = claim_refs.unionByName(hit_refs).groupBy("query_id", "item").agg(F.min(F.struct("from_hit", "rank", "nth")).alias("o"))
    evidence = evidence.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "item")))
    results = ok.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "source")))
    some = hit_refs.select("query_id").union(matched.select("set_id").distinct().join(of, "set_id").select("query_id")).distinct().withColumn("some", F.lit(True))
    outcome = queries.select("query_id").join(conflicting, "query_id", "left").join(some, "query_id", "left")
    outcome = outcome.select("query_id", F.lit("outcome").alias("kind"), F.lit(1).alias("position"), F.when(F.col("conflicting"), "conflicting").when(F.col("some"), "supported").otherwise("insufficient_evidence").alias("item"))
    parts = [
        ranked.select("query_id", F.lit("claim").alias("kind"), "position", F.col("claim_id").cast("string").alias("item")),
        evidence.where(F.col("position") <= 3 * max_results).select("query_id", F.lit("evidence").alias("kind"), "position", "item"),
        results.where(F.col("position") <= max_results).select("query_id", F.lit("result").alias("kind"), "position", F.col("source").alias("item")),
        outcome,
    ]
    return reduce(DataFrame.unionByName, parts)


# --- revocation -----------------------------------------------------------------------------------------------------


def blocked_documents(docs: DataFrame, sources: DataFrame, registry: DataFrame, revocations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """path, reasons (sorted): documents that any of four feeds blocks.

    A match on any of source_id, canonical URL or destination is written as one equi join on key text, not as an OR: each feed becomes (key, reason), each document the keys of its source (destination, source_id, canonical).
    """
    place = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[./]+", ""), "^rag/documents/", "")
    keyed = lambda df, reason, *columns: df.select(F.explode(F.array_compact(F.array(*columns))).alias("key"), F.lit(reason).alias("reason"))
    s = sources.select(place(F.col("destination")).alias("path"), "source_id", "canonical", F.coalesce("revoked", F.lit(False)).alias("revoked"))
    feeds = [
        keyed(registry.where("status IN ('withdrawn', 'revoked')"), "registry", "source_id", "canonical"),
        keyed(revocations.where("coalesce(revoked, true)"), "revocation", "source_id", "canonical"),
        keyed(s.where("revoked"), "source_revoked", "source_id", "canonical", F.concat(F.lit("path:"), "path")),
        keyed(tombstones, "tombstone", F.concat(F.lit("path:"), place(F.col("path")))),
    ]
    blocks = reduce(DataFrame.unionByName, feeds).where("trim(key) <> ''").distinct()
    keys = s.select("path", F.explode(F.array_compact(F.array(F.col("source_id"), F.col("canonical")))).alias("key")).unionByName(docs.select("path", F.concat(F.lit("path:"), "path").alias("key")))
    found = keys.join(blocks, "key").join(docs.select("path"), "path", "left_semi")
    return found.groupBy("path").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def filter_revoked_hits(hits: DataFrame, blocked: DataFrame) -> DataFrame:
    return hits.join(blocked.select("path").distinct(), "path", "left_anti")


def revoke_sources(revoked: DataFrame, sources: DataFrame, refs: DataFrame) -> DataFrame:
    """source_id, destinations, claims (sorted): what revoking each source takes along."""
    d = sources.join(revoked.select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_set("destination")).alias("destinations"))
    c = refs.join(revoked.select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claims"))
    out = revoked.select("source_id").distinct().join(d, "source_id", "left").join(c, "source_id", "left")
    return out.select("source_id", F.coalesce("destinations", F.array().cast("array<string>")).alias("destinations"), F.coalesce("claims", F.array().cast(c.schema["claims"].dataType)).alias("claims"))


def derivative_check(lessons: DataFrame, claims: DataFrame, eligible: DataFrame) -> DataFrame:
    """lesson_id, code of every fault of lessons (course_id, lesson_id, content, refs array of claim ids): duplicate or missing ids, no content, no evidence, unknown or ineligible evidence, references to the course itself."""
    nth = F.row_number().over(Window.partitionBy("course_id", "lesson_id").orderBy("position"))
    l = lessons.withColumn("_n", nth)
    bad_id = F.coalesce(F.trim("lesson_id"), F.lit("")) == ""
    own = l.select("lesson_id", F.explode(F.array_compact(F.array(
        F.when(bad_id | (F.col("_n") > 1), "duplicate_or_missing_lesson_id"),
        F.when(~bad_id & (F.col("_n") == 1) & (F.coalesce(F.trim("content"), F.lit("")) == ""), "lesson_missing_objective_or_content"),
        F.when(~bad_id & (F.col("_n") == 1) & (F.coalesce(F.size("refs"), F.lit(0)) <= 0), "lesson_missing_evidence"),
    ))).alias("code"))
    r = l.where(~bad_id & (F.col("_n") == 1)).select("course_id", "lesson_id", F.explode("refs").alias("claim_id"))
    r = r.join(claims.select("claim_id", F.lit(True).alias("known")), "claim_id", "left").join(eligible.select("claim_id", F.lit(True).alias("ok")), "claim_id", "left")
    code = F.when(F.col("known") & F.col("ok").isNull(), "ineligible_lesson_evidence").when(F.col("known").isNull() & F.contains("claim_id", F.col("course_id")), "self_referential_proof").when(F.col("known").isNull(), "unknown_lesson_evidence_reference")
    return own.unionByName(r.select("lesson_id", code.alias("code")).where("code IS NOT NULL"))


def version_divergence(manifests: DataFrame, skills: DataFrame) -> DataFrame:
    """package_id, code: the source's version against the one that the skill text states on a line ``- Version: `...` ``."""
    s = skills.select("package_id", F.regexp_extract("text", "(?m)^- Version: `([^`]*)`$", 1).alias("skill_version"), F.col("text").rlike("(?m)^- Version: `[^`]*`$").alias("marked"), F.lit(True).alias("_has"))
    m = manifests.join(s, "package_id", "left")
    code = (
        F.when(F.col("_has").isNull(), "divergence_inputs_missing").when(F.col("version").isNotNull() & (F.col("skill_version") != "") & (F.col("version") != F.col("skill_version")), "skill_rag_divergence")
        .when(F.col("version").isNotNull() & (F.col("skill_version") == ""), "skill_version_missing").otherwise("synchronized")
    )
    return m.select("package_id", code.alias("code"))
