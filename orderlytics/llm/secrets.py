"""Secret scan with an incremental ledger of blobs.

A text is a blob, addressed by its SHA-256. The ledger remembers which rules, by
name and version, each blob was scanned with and what they found. A scan looks
at one holder of each blob and only at pairs of blob and rule that the ledger
lacks; findings then join back to every row ("path") that has the blob, so a new
version of a rule, or a new batch full of old files, costs what is new. The ledger
is a shared folder: a later session that opens it knows all finished scans. Every
span names its rule and version, and only those of the rules in use are reported.
One writer at a time; a scan that failed leaves nothing that counts.

Positions count code points, ends are exclusive. Matches of one kind are
leftmost and do not overlap. NULL texts are empty and have no findings; repeated
rows have findings each; no rows give no rows. Only DataFrame expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlytics.llm.common import ROW, text_of, wrapped
from orderlytics.session import cut_lineage, finished_folders, read_back, scratch_path


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    value: int  # the group whose length counts
    least: int  # characters it needs
    quick: str  # holds wherever the pattern has a match that counts
    base: bool

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which kinds are listed at one start. The last two are ours. A run of the
#: characters of access or hex that is too short has no match that counts anywhere in it, so
#: their patterns ask for the length at once; a short assignment hides what it covers.
RULES = (
    Rule("assign", 1, _ASSIGN, 2, 12, _ASSIGN.removesuffix("+)") + "{12,})", True),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14,}", True),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16,}", True),
    Rule("private", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_[A-Za-z0-9]{36,}", False),
)
SALTS = 16
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,rule:string>"
LEDGER = f"blob binary, rules array<string>, spans array<{SPAN}>"


class BlobLedger:
    """Entries (blob, rules, spans) in a shared folder, one subfolder per scan."""

    def __init__(self, spark: SparkSession, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> None:
        self.spark, self.rules = spark, rules
        self.folder = folder or scratch_path(spark, "blob-ledger")

    def scans(self) -> list[str]:
        """Folders of the finished scans, of this session or an earlier one."""
        return [f"{self.folder}/{name}" for name in finished_folders(self.spark, self.folder)]

    def entries(self) -> DataFrame:
        scans = self.scans()
        if not scans:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*scans)

    def scan(self, docs: DataFrame, text: str = "text", id: str = "doc_id") -> int:
        """Scan what is new in `docs`; returns how many blobs that were."""
        held = docs.select(text_of(text).alias("body"), F.xxhash64(id).alias("holder"))
        held = held.withColumn("blob", F.unhex(F.sha2("body", 256)))
        every = F.array(*[F.lit(r.id) for r in self.rules])
        # One holder per blob, found before any text moves: a third of all rows may be one blob.
        blobs = held.groupBy("blob").agg(F.min("holder").alias("holder"))
        seen = self.entries().select("blob", F.explode("rules").alias("rule"))
        seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        pending = blobs.join(seen, "blob", "left").select("blob", "holder", todo.alias("rules")).where(F.size("rules") > 0)
        pending = cut_lineage(pending, "pending-blobs")
        texts = held.join(pending.hint("shuffle_hash"), ["blob", "holder"])
        hits = cut_lineage(texts.where(self._quick()).select("blob", "body", "rules").dropDuplicates(["blob"]), "hits")
        spans = hits.join(self._spans(hits), "blob").select("blob", "spans")
        path = f"{self.folder}/scan-{uuid.uuid4().hex}"
        pending.select("blob", "rules").join(spans, "blob", "left").select("blob", "rules", "spans").write.parquet(path)
        return read_back(pending, path).count()

    def _quick(self) -> Column:
        any_rule = F.lit(False)
        for r in self.rules:
            any_rule |= F.array_contains("rules", r.id) & F.col("body").rlike(r.quick)
        return any_rule

    def _spans(self, hits: DataFrame) -> DataFrame:
        """(blob, spans): a match starts after all that was between and inside the matches before it."""
        kinds = []
        for rank, r in enumerate(self.rules):
            pattern = F.lit(r.pattern)
            parts = F.arrays_zip(
                F.split("body", r.pattern, -1).alias("gap"),
                F.regexp_extract_all("body", pattern, F.lit(0)).alias("found"),
                F.regexp_extract_all("body", pattern, F.lit(r.value)).alias("value"),
            )
            asked = F.array_contains("rules", r.id) & F.col("body").rlike(r.quick)
            lengths = F.transform(
                F.when(asked, parts),
                lambda p: F.struct(
                    F.length(p["gap"]).alias("gap"), F.length(p["found"]).alias("found"), F.length(p["value"]).alias("value")
                ),
            )
            head = [F.lit(rank).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.id).alias("rule"), F.lit(r.least).alias("least")]
            kinds.append(F.struct(*head, lengths.alias("parts")))
        each = hits.select("blob", F.explode(F.array(*kinds)).alias("k"))
        each = each.select("blob", "k.rank", "k.kind", "k.rule", "k.least", F.posexplode("k.parts").alias("nth", "p"))
        each = each.where("p.found IS NOT NULL")
        upto = Window.partitionBy("blob", "rank").orderBy("nth")
        end = F.sum(F.col("p.gap") + F.col("p.found")).over(upto)
        placed = each.withColumn("end", end.cast("bigint")).where("p.value >= least")
        span = F.struct((F.col("end") - F.col("p.found")).cast("bigint").alias("start"), "rank", "kind", "end", "rule")
        return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))

    def findings(self) -> DataFrame:
        """(blob, spans) of the blobs in which a rule in use, in its version, found something."""
        used = [r.id for r in self.rules]
        found = self.entries().select("blob", F.filter("spans", lambda s: s["rule"].isin(used)).alias("spans"))
        found = found.where(F.size("spans") > 0)
        return found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def joined(
        self, docs: DataFrame, text: str = "text", id: str = "doc_id", keep: Sequence[str] | None = None
    ) -> DataFrame:
        """Rows (wrapped) with counts by kind, `base`, `spans`: what the ledger knows of their texts.

        `keep` names the columns of the rows to carry along, all by default; texts
        are only shuffled when they are among them.
        """
        carried = docs.select(*[F.col(f"`{c}`") for c in (keep or docs.columns)])
        paths = docs.select(wrapped(carried), F.unhex(F.sha2(text_of(text), 256)).alias("blob"), F.xxhash64(id).alias("salt"))
        # Rows of one blob are dealt over several keys; findings are few and repeated for each.
        paths = paths.withColumn("salt", F.pmod("salt", F.lit(SALTS).cast("bigint")))
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        found = self.findings().withColumn("salt", salts)
        all_spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
        base_kinds = [r.kind for r in self.rules if r.base]
        base = F.filter("all", lambda s: s["kind"].isin(base_kinds))
        count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
        rows = paths.join(found, ["blob", "salt"], "left").select(ROW, all_spans.alias("all"))
        return rows.select(ROW, *map(count, base_kinds), _listed(base).alias("base"), _listed(F.col("all")).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
