"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger holds, for
each blob and rule version, the spans found.  A scan reads the text of one representative of
each (blob, rule version) that the ledger lacks, adds those to it, and joins the findings back
to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import bind, upto
from .shared import cut, divided, shared_path

RULE_VERSION = "3"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # code points; a match below it is dropped after matching
    base: bool = False


_NAMES = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
# A run of one class holds its only possible match, so "and so many characters or more" can stand in the pattern.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    # With its body to the line that ends it; where that is missing, to the end of the base64 that follows.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\t\r\n]*-----END [A-Z ]*PRIVATE KEY-----|[\x20\t\r\n]*[A-Za-z0-9+/=]{40,})?"),
    # A run without the parts that must follow is taken whole and dropped: nothing inside it can match, and it is read once.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+(\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?", 1),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"
PART = 1024  # characters of a text that are cut out of at once


def running(values: Column, start: Column, step) -> Column:
    """``step`` of ``start`` and all values up to each place.

    In two levels, over runs as long as there are runs: an array is only ever grown within a run
    or by one element for each run.
    """
    def grown(first: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))

    def by_runs(v: Column) -> Column:
        long = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        return F.transform(upto(F.ceil(F.size(v) / long).cast("int")), lambda i: F.slice(v, i * long + 1, long))

    def laid(runs: Column) -> Column:
        wholes = F.transform(runs, lambda run: F.aggregate(run, start, step))
        return bind(grown(start, wholes), lambda begin: F.flatten(F.transform(runs, lambda run, i: F.slice(grown(begin[i], run), 2, F.size(run)))))

    return bind(values, lambda v: bind(by_runs(v), laid))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule: the text between matches and the matches themselves, laid end to end."""
    pattern = F.lit(rule.pattern)

    def laid(match: Column) -> Column:
        def by_ends(gap: Column) -> Column:
            ends = running(F.transform(match, lambda m, i: F.char_length(gap[i]) + F.char_length(m)), F.lit(0), lambda a, x: a + x)
            return bind(ends, lambda end: F.transform(match, lambda m, i: F.struct((end[i] - F.char_length(m)).alias("start"), F.lit(rank).alias("rank"), end[i].alias("stop"), F.lit(rule.kind).alias("kind"))))

        return bind(F.split(text, rule.pattern, -1), by_ends)

    found = bind(F.regexp_extract_all(text, pattern, F.lit(0)), laid)
    if rule.group or rule.least > 1:
        kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        found = bind(kept, lambda part: F.filter(found, lambda _, i: F.char_length(part[i]) >= rule.least))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then by the order of the rules; null is an empty text."""
    return F.array_sort(reduce(lambda a, b: F.concat(a, b), (rule_spans(F.coalesce(text, F.lit("")), r, i) for i, r in enumerate(rules))))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """``versions(path, text)`` and what earlier scans left; to findings and the new ledger entries.

    Findings ``(path, blob, spans)`` have one row per row of ``versions``.  New entries ``(blob,
    rule_version, spans)``, also for blobs without findings, are written to the shared folder;
    append them to the ledger.  Null texts are empty; a null path is a path.  Repeated versions
    are scanned once and reported for each.  No versions: no rows.
    """
    slim = versions.select("path", "text")
    addressed = cut(slim.select("path", blob_of(F.col("text")).alias("blob")))
    fresh = addressed.groupBy("blob").agg(F.min(F.struct("path")).alias("at"))
    known = None
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob", "rule_version", "spans")
        fresh = fresh.join(known.select("blob"), "blob", "left_anti")
    fresh = fresh.select(F.col("blob").alias("b"), F.col("at.path").alias("p"))
    # Blobs with one path are scanned where they lie; of others, only the text of one path moves, or none where the ledger has it.
    several = addressed.groupBy(F.xxhash64("blob").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    if known is not None:
        several = several.unionByName(known.select(F.xxhash64("blob").alias("key")))
    moved, alone = divided(slim.withColumn("blob", blob_of(F.col("text"))), F.xxhash64("blob"), several)
    moved = moved.join(fresh, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
    where = shared_path(versions.sparkSession, "secret-ledger")
    alone.unionByName(moved).select("blob", F.lit(rule_version).alias("rule_version"), spans_of(F.col("text"), rules).alias("spans")).write.parquet(where)
    entries = versions.sparkSession.read.parquet(where).dropDuplicates(["blob", "rule_version"])
    all_known = entries if known is None else entries.unionByName(known).dropDuplicates(["blob", "rule_version"])
    hits = all_known.where(F.size("spans") > 0).select("blob", "spans")
    findings = addressed.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return findings, entries


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mask``; spans rise by start.  Null is an empty text.

    Pieces are cut out of short parts of the text, so the work grows with text and spans, not
    with their product.
    """
    text = F.coalesce(text, F.lit(""))

    def masked(parts: Column, own: Column, reach: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            inside = F.transform(F.sequence((begin / PART).cast("int"), ((end - 1) / PART).cast("int")), lambda i: F.substring(parts[i], F.greatest(begin - i * PART, F.lit(0)) + 1, F.least(end - i * PART, F.lit(PART)) - F.greatest(begin - i * PART, F.lit(0))))
            return F.when(end > begin, F.array_join(inside, "")).otherwise("")

        def before(i: Column) -> Column:
            return F.when(i > 0, reach[i - 1]).otherwise(0)

        heads = F.filter(upto(F.size(own)), lambda i: (i == 0) | (own[i]["start"] >= before(i)))
        front = F.transform(heads, lambda i: F.concat(piece(before(i), own[i]["start"]), F.lit(mask)))
        return F.concat(F.array_join(front, ""), piece(F.element_at(reach, -1), F.char_length(text)))

    def cut_up(own: Column) -> Column:
        return bind(running(F.transform(own, lambda s: s["stop"]), F.lit(0), lambda a, x: F.greatest(a, x)), lambda reach: bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda parts: masked(parts, own, reach)))

    return F.when(F.size(spans) > 0, bind(spans, cut_up)).otherwise(text)


def digest(findings: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans in writing."""
    ranks = [i for i, r in enumerate(RULES) if r.base]
    base = F.filter("spans", lambda s: s["rank"].isin(ranks))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return findings.select(F.col("path").alias("doc_id"), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for i, r in enumerate(RULES):
        parts.append(f"""SELECT d, {i} AS k, {quoted(r.kind)} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: [
            list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
            list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))), length(v[i])])) AS s
          FROM (SELECT doc_id AS d, string_split_regex(text, {quoted(r.pattern)}) AS g, regexp_extract_all(text, {quoted(r.pattern)}) AS m,
            regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS v FROM documents WHERE regexp_matches(text, {quoted(r.pattern)}))""")
    least = "CASE k " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES)) + " END"
    base = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
    return f"""
WITH a AS ({' UNION ALL '.join(parts)}),
b AS (SELECT d, k, kind, CAST(s[1] AS BIGINT) AS x, CAST(s[2] AS BIGINT) AS y FROM a WHERE s[3] >= {least}),
c AS (SELECT d, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || x || ':' || y, ',' ORDER BY x, k) FILTER (k IN ({base})) AS bs, string_agg(kind || ':' || x || ':' || y, ',' ORDER BY x, k) AS spans FROM b GROUP BY d)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN c ON doc_id = d
"""


SQL = _sql()
