"""Language identification by Bayesian fusion of independent evidence.

For each document and language, in logarithms:

* the text: hashed byte trigrams of the lower-cased text under a model per
  language, counted over the corpus by the declared languages (one grouped
  aggregation). Overlapping trigrams repeat each other's evidence, so their sum
  is taken as `1 / REPEAT` of it, and of at most `ENOUGH` trigrams' worth: a
  long text may weigh much, but not without bound;
* the declared markup language, by its primary subtag (`en-US` is `en`): right with
  probability `TRUST`, else any. What is no well-formed tag declares nothing, so dirt in
  the column makes no languages;
* the address suffix, where there is an address: `.fr`, `.de`, `.es` … and path
  segments like `/en/`, with probability `HINT`;
* a prior of the host, smoothed by the prior of all hosts, itself smoothed by
  the uniform: (count + S * wider prior) / (total + S).

A document is rejected when its text has no trigram of letters, when it is
unlike any modelled language (mean log-likelihood under the best model below
`UNLIKE`), or when the best language has a posterior below `CERTAIN`.

NULL and empty texts are rejected, with language NULL. NULL declarations and
hosts give no evidence of their own (a NULL host is one host). An empty corpus
has no languages and gives no rows. Repeated rows are judged each. Of languages that
tie, the one declared more often wins, then the first by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlytics.llm.common import ROW, portions, text_of, wrapped
from orderlytics.session import cut_lineage

BUCKETS = 1 << 16
BLOCK = 64  # languages whose models go to the tasks at once; there may be any number of blocks
CHAIN = 4  # blocks that are scored in one go
REPEAT = 3.0
ENOUGH = 300
TRUST = 0.9
HINT = 0.8
SMOOTH = 20.0
CERTAIN = 0.6
UNLIKE = -10.8  # about ln(1 / BUCKETS) + 0.3: hardly better than trigrams at random
UNKNOWN = ""

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[128:] = True


def _trigrams(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of letters (and what separates words, as one sign), and the text of each."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = _LETTER[data]
    code = np.where(letter, _FOLD[data], np.uint32(32))
    key = (code[:-2] * np.uint32(0x10000) + code[1:-1] * np.uint32(0x100) + code[2:]) * np.uint32(0x9E3779B1)
    use = letter[:-2] | letter[2:]
    use &= letter[1:-1]  # one that turns on a letter
    for back in (1, 2):
        cut = texts[1:-1] - back
        use[cut[(cut >= 0) & (cut < len(use))]] = False
    at = np.flatnonzero(use)
    return (key[at] >> np.uint32(16)).astype(np.int64), np.searchsorted(texts, at, "right") - 1


def _numbers(column: pa.Array, number: dict[str, int]) -> np.ndarray:
    """The languages' numbers; -1 for what is none."""
    coded = column.dictionary_encode()
    known = np.array([*(number.get(x, -1) for x in coded.dictionary.to_pylist()), -1], np.int64)
    return known[coded.indices.fill_null(len(known) - 1).to_numpy()]


def _counted(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, of in counts.items():
        bucket = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(bucket), lang), pa.int32()), pa.array(bucket, pa.int32()), pa.array(of[bucket])],
            ["lang", "bucket", "n"],
        )


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, np.ndarray] = {}
    number = {l: i for i, l in enumerate(languages)}
    for batch in batches:
        declared = _numbers(batch.column("declared"), number)
        for first, last, data, texts in portions(batch.column("body")):
            key, of = _trigrams(data, texts)
            own = declared[first:last][of]
            order = np.argsort(own, kind="stable")
            key, own = key[order], own[order]
            langs, starts = np.unique(own, return_index=True)
            for lang, a, b in zip(langs.tolist(), starts, [*starts[1:], len(own)]):
                if lang < 0:
                    continue
                if lang not in counts and len(counts) >= BLOCK:
                    yield from _counted(counts)
                    counts = {}
                counts[lang] = counts.get(lang, 0) + np.bincount(key[a:b], minlength=BUCKETS)
    yield from _counted(counts)


#: What the blocks scored so far have found: the best language and its score, the logarithm of the sum of
#: all likelihoods, the best fit of the text, and the number of trigrams.
_FOUND = {"language": T.StringType(), "score": T.DoubleType(), "whole": T.DoubleType(), "text_fit": T.DoubleType(), "seen": T.LongType()}
_STATE = T.StructType([T.StructField(name, kind) for name, kind in _FOUND.items()])


def _score(
    batches: Iterator[pa.RecordBatch], languages: list[str], n: int, model: np.ndarray, everywhere: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Score a block of the `n` languages and join it with what the blocks before have found."""
    size = len(languages)
    number = {l: i for i, l in enumerate(languages)}
    for batch in batches:
        rows = batch.num_rows
        fit, seen = np.zeros((size, rows)), np.zeros(rows)
        for first, last, data, texts in portions(batch.column("body")):
            key, of = _trigrams(data, texts)
            seen[first:last] = np.bincount(of, minlength=last - first)
            for k in range(size):
                fit[k, first:last] = np.bincount(of, model[k][key], last - first)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(seen > 0, fit / seen, 0.0)
        score = mean * np.minimum(seen, ENOUGH) / REPEAT
        for name, right in (("declared", TRUST), ("hint", HINT)):
            # A language of another block is evidence against all of this one.
            some = batch.column(name).is_valid().to_numpy(zero_copy_only=False)
            own = _numbers(batch.column(name), number)[None, :] == np.arange(size)[:, None]
            sure = np.where(own, np.log(right + (1 - right) / n), np.log((1 - right) / n))
            score += np.where(some[None, :], sure, 0.0)
        # Of the host's languages only those that it has are listed.
        told = batch.column("told").to_numpy(zero_copy_only=False).astype(float)
        listed = batch.column("prior")
        of = pa.compute.list_parent_indices(listed).to_numpy()
        flat = listed.flatten()
        which, count = _numbers(flat.field("declared"), number), flat.field("n").to_numpy(zero_copy_only=False)
        prior = np.repeat(SMOOTH * everywhere[:, None], rows, axis=1)
        here = which >= 0
        prior[which[here], of[here]] += count[here]
        score += np.log(prior / (told + SMOOTH))

        best, at = score.argmax(axis=0), np.arange(rows)
        top, text_fit = score[best, at], mean.max(axis=0)
        whole = top + np.log(np.exp(score - top).sum(axis=0))
        names = np.array(languages, object)[best]
        before = batch.column("state")
        if before.null_count < rows:
            old = {f: before.field(f).to_numpy(zero_copy_only=False) for f in ("language", "score", "whole", "text_fit")}
            names = np.where(old["score"] >= top, old["language"], names)
            top, text_fit = np.maximum(old["score"], top), np.maximum(old["text_fit"], text_fit)
            whole = np.logaddexp(old["whole"], whole)
        made = [pa.array(names, pa.string()), pa.array(top), pa.array(whole), pa.array(text_fit), pa.array(seen.astype(np.int64))]
        rest = [c for c in batch.schema.names if c != "state"]
        state = pa.StructArray.from_arrays(made, list(_FOUND))
        yield pa.RecordBatch.from_arrays([*map(batch.column, rest), state], [*rest, "state"])


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def suffix_language(url: Column, languages: list[str]) -> Column:
    """The language that an address names as a path segment or else ends in, if any."""
    end = F.regexp_extract(host_of(url), r"\.([a-z]+)(?::\d+)?$", 1)
    path = F.regexp_extract(url, "://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    known = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    return F.when(F.array_contains(known, path), path).when(F.array_contains(known, end), end)


def primary_subtag(tag: Column) -> Column:
    """The language of a tag like `en`, `en-US` or `zh_Hant`, lower-cased; NULL for what is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), "^([a-z][a-z0-9]{1,7})(?:[-_].*)?$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    """The `lang` attribute of the `html` element, NULL where there is none."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z0-9_-]+)""", 1), F.lit(""))


def markup_text(html: Column) -> Column:
    """The page without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def pages_identified(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Web pages judged by all four kinds of evidence: text, markup, address and host.

    Rows as `identified` gives them. A missing page is an empty text, a missing
    address gives no suffix and belongs to the NULL host.
    """
    page, address = F.col(f"`{html}`"), F.col(f"`{url}`")
    return identified(pages, markup_text(page), markup_language(page), host_of(address), address)


def identified(
    docs: DataFrame,
    text: str | Column = "text",
    declared: str | Column | None = "lang",
    host: str | Column | None = "source",
    url: str | Column | None = None,
) -> DataFrame:
    """Rows (wrapped) with language, posterior, text_fit and `rejected`.

    The corpus is read once for its declarations, once for the trigram counts
    and once to be judged. All declared languages are modelled, in blocks; what
    goes to the tasks at once is the table of a block, and a prior per host that
    joins by host.
    """
    none = F.lit(None).cast("string")
    declared, host, url = (none if c is None else F.col(c) if isinstance(c, str) else c for c in (declared, host, url))
    base = docs.select(
        wrapped(docs),
        text_of(text).alias("body"),
        primary_subtag(declared).alias("declared"),
        host.alias("host"),
        url.cast("string").alias("address"),
    )
    by_host = base.groupBy("host", "declared").agg(F.count(F.lit(1)).alias("n"))
    totals = by_host.groupBy("declared").agg(F.sum("n").alias("n")).where("declared IS NOT NULL")
    known = [(r.declared, r.n) for r in totals.orderBy(F.desc("n"), "declared").collect()]
    total = sum(m for _, m in known)
    languages = [l for l, _ in known]
    if not languages:
        verdict = [none.alias("language"), F.lit(None).cast("double").alias("posterior")]
        return base.select(ROW, *verdict, F.lit(None).cast("double").alias("text_fit"), F.lit(True).alias("rejected"))
    n = len(languages)

    counts = (
        base.select("body", "declared")
        .mapInArrow(lambda it: _count(it, languages), "lang int, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    if n > BLOCK:
        counts = cut_lineage(counts, "trigram-counts")
    everywhere = np.array([(m + SMOOTH / n) / (total + SMOOTH) for _, m in known])
    entry = F.when(F.col("declared").isNotNull(), F.struct("declared", "n"))
    priors = by_host.groupBy("host").agg(
        F.collect_list(entry).alias("prior"), F.coalesce(F.sum(entry["n"]), F.lit(0)).alias("told")
    )
    # Hosts joined by name; a host that holds a third of all rows is dealt over several keys.
    salted = base.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALTS)))
    spread = priors.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    same = (F.col("l.host").eqNullSafe(F.col("r.host"))) & (F.col("l.salt") == F.col("r.salt"))
    few = by_host.count() <= BROADCAST_HOSTS
    right = F.broadcast(priors.alias("r")) if few else spread.alias("r")
    joined = salted.alias("l").join(right, F.col("l.host").eqNullSafe(F.col("r.host")) if few else same, "left")
    hint = suffix_language(F.col("address"), languages)
    ready = joined.select(
        ROW, "body", F.col("l.declared").alias("declared"), hint.alias("hint"), "prior", "told",
        F.lit(None).cast(_STATE).alias("state"),
    )
    schema = ready.schema
    for k, first in enumerate(range(0, n, BLOCK)):
        if k and k % CHAIN == 0:
            ready = cut_lineage(ready, "language-scores")
        last = min(first + BLOCK, n)
        # At most BLOCK * BUCKETS rows, whatever the corpus.
        part = counts.where(F.col("lang").between(first, last - 1)).toArrow()
        model = np.full((last - first, BUCKETS), 0.5)
        model[part["lang"].to_numpy() - first, part["bucket"].to_numpy()] += part["n"].to_numpy()
        model = np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)
        ready = ready.mapInArrow(_scorer(languages[first:last], n, model, everywhere[first:last]), schema)
    s = {f: F.col("state")[f] for f in _FOUND}
    posterior = F.exp(s["score"] - s["whole"])
    rejected = (s["seen"] == 0) | (s["text_fit"] < UNLIKE) | (posterior < CERTAIN)
    return ready.select(
        ROW,
        F.when(s["seen"] > 0, s["language"]).alias("language"),
        posterior.alias("posterior"),
        s["text_fit"].alias("text_fit"),
        rejected.alias("rejected"),
    )


def _scorer(*block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _score(batches, *block)


BROADCAST_HOSTS = 100_000  # pairs of a host and a language
SALTS = 16
