"""Secret scanning over an incremental blob ledger (DataFrame functions only).

Every version of every path is content-addressed (SHA-256 of its bytes). Only pairs of blob and rule version that the ledger
doesn't hold are scanned, each blob once however many paths carry it, and the findings are joined back to all paths.

Positions come from the matches and the gaps between them: a running sum of their lengths in code points. Base kinds are
scanned leftmost and non-overlapping; a match that fails its length test is dropped after it has taken its characters.

Defined results: null text is empty; an empty text and an empty table have no findings; repeated rows and null ids are paths of
their own; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Rule:
    """One kind: a pattern, the group whose length is tested, the least length, and a text every match contains ("" if none)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""


#: [0-9a-f]+ of 16 and more characters, and AKIA[A-Z0-9]+ of 18 and more, are the same runs as these bounded forms find.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs="eyJ"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("chat_token", r"xox[abprs]-[0-9A-Za-z-]{10,}", needs="xox"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "2024-1"
#: Lists of rows to scan, or to leave out, are broadcast up to this many rows; longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _hits(rule: Rule) -> F.Column:
    """array<struct<gap, len, tested>>, empty if the kind doesn't occur."""
    text, pattern = F.col("__text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(F.contains(text, F.lit(rule.needs)), found).otherwise(F.array().cast("array<string>")) if rule.needs else found


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs(digest, __text) -> findings(digest, kind, kind_no, start, end), code points, end exclusive."""
    found = blobs.select("digest", "__text", *[_hits(r).alias(f"__m{i}") for i, r in enumerate(rules)])
    found = found.where(" or ".join(f"size(__m{i}) > 0" for i in range(len(rules))))
    spans = []
    for i, rule in enumerate(rules):
        gaps = F.transform(F.split("__text", rule.pattern, -1), lambda x: F.length(x))
        sizes = F.transform(f"__m{i}", lambda x: F.length(x))
        tested = F.transform(F.regexp_extract_all(F.col("__text"), F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x)) if rule.group else sizes
        zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("len"), tested.alias("tested"))
        none = F.array().cast("array<struct<gap:int,len:int,tested:int>>")
        spans.append(F.struct(F.lit(i).alias("kind_no"), F.when(F.size(f"__m{i}") > 0, zipped.cast("array<struct<gap:int,len:int,tested:int>>")).otherwise(none).alias("hits")))
    rows = found.select("digest", F.explode(F.array(*spans)).alias("k")).select("digest", "k.kind_no", F.posexplode("k.hits").alias("pos", "hit")).where("hit.len is not null")
    rows = rows.select("digest", "kind_no", "pos", "hit.*").dropDuplicates(["digest", "kind_no", "pos"])
    so_far = Window.partitionBy("digest", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind_no") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind_no") + 1)
    return (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far))
        .where(F.col("tested") >= least)
        .select("digest", kind.alias("kind"), "kind_no", (F.col("end") - F.col("len")).alias("start"), "end")
    )


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Content addresses of every row: path, digest."""
    return docs.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings of all blobs of docs, new ledger).

    ledger(digest, rule_version, findings array<struct<kind, kind_no, start, end>>): a row for each scanned pair, kept
    by the caller as a table. A pair that it holds isn't scanned again.
    """
    paths = materialize(versions(docs, path, text), "blob-paths")
    blobs = paths.groupBy("digest").agg(F.min("path").alias("first_path"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version)
        blobs = blobs.join(seen.select("digest"), "digest", "left_anti")
    todo = materialize(blobs, "blob-todo")
    # rows left out: further copies of a blob, and blobs that are in the ledger
    ours = F.col("p.path").eqNullSafe(F.col("t.first_path")) & (F.col("p.digest") == F.col("t.digest"))
    skipped = paths.alias("p").join(todo.alias("t"), ours, "left_anti")
    skipped = materialize(skipped.select(F.col("path").alias("s_path"), F.col("digest").alias("s_digest")).distinct(), "blob-skipped")
    texts = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("digest", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)))
    out = F.col("path").eqNullSafe(F.col("s_path")) & (F.col("digest") == F.col("s_digest"))
    few = skipped.count() <= BROADCAST_ROWS
    fresh = scan(texts.join(F.broadcast(skipped) if few else skipped, out, "left_anti"), rules)
    per_blob = fresh.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind"))).alias("findings"))
    per_blob = materialize(per_blob, "blob-findings")
    entries = todo.select("digest").join(per_blob, "digest", "left").select("digest", F.lit(rule_version).alias("rule_version"), "findings")
    if ledger is None:
        return paths, per_blob, entries
    known = seen.where("findings is not null").join(paths.select("digest").distinct(), "digest", "left_semi").select("digest", "findings")
    return paths, per_blob.unionByName(known), ledger.unionByName(entries)


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row per path: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    paths, findings, _ = scan_unseen(docs, ledger)
    base = len(BASE_RULES)
    own = F.filter("findings", lambda x: x["kind_no"] < base)
    count = [F.expr(f"size(filter(findings, x -> x.kind_no = {i}))").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    digests = findings.select("digest", *count, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
    zero = {f"n_{r.kind}": 0 for r in BASE_RULES}
    out = paths.join(digests, "digest", "left").fillna(zero | {"spans": ""})
    return out.select(F.col("path").alias("doc_id"), *zero, F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), "spans")
