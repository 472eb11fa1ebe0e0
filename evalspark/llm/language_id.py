"""Language of documents by fusing what different kinds of evidence say.

The posterior of a language multiplies

- the likelihood of the text: a model of letter triples, fitted on a bounded sample
  of labelled rows,
- the likelihood of the declared language (markup or metadata): how often texts of
  each language declare each language, counted over all rows,
- the prior of the host: counts of languages over all rows of the host, smoothed
  towards those of its parent domain, then the address suffix, then all rows. A row
  is not counted for itself.

Counts are grouped sums of the text posteriors, so a host with a third of all rows
is combined before the shuffle like any other.

A text fits a label when its mean log likelihood per triple is near that of labelled rows,
each scored without its own triples, and above that of triples drawn at random. One that
fits no label, neither as a whole nor in half of its pieces, is no evidence and is rejected.

Labels and declared languages are compared by ``language_code``. There may be any
number of labels: the driver holds the pairs of label and triple, and of declared and
found language, that occur, and rows hold the languages that can still matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import keep_table, mix, slices
from evalspark.operators.ranking import first_per_group

TRAIN_ROWS = 1000  # labelled rows per language that the text model is fitted on, at most
BUCKETS = 1 << 15
HOST_WEIGHT = 5.0
_TRIPLE_WEIGHT = 1 / 3  # neighbouring triples share letters
_SMOOTH = 0.1
_FAR = 1000.0  # exp(-1000) is 0 in double precision, also after any prior
_CELLS = 1_000_000
DEVIATIONS = 6.0  # how far below its label's usual likelihood a fitting text may be
_PIECE = 50  # triples


def triples(text: str) -> np.ndarray:
    """Buckets of the letter triples of a text: lower case, other characters as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xAA) & (codes != 0xD7) & (codes != 0xF7))
    codes = np.where(letter, codes, 32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    key = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return (mix(key) % np.uint64(BUCKETS)).astype(np.int64)


class TextModel:
    """log P(triple | language), smoothed; only the pairs of bucket and language that occur are held."""

    def __init__(self, languages: list[str], language: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.languages = languages
        order = np.lexsort((language, bucket))
        self.language, self.n = language[order].astype(np.int32), n[order].astype(np.float64)
        self.starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.gain = np.log1p(self.n / _SMOOTH)
        self.total = np.bincount(self.language, self.n, minlength=len(languages))
        self.unseen = np.log(_SMOOTH / (self.total + _SMOOTH * BUCKETS))

        self.level = self.between = self.within = np.full(len(languages), np.nan)

    def score(self, text: str) -> tuple[np.ndarray, int, bool]:
        """Log likelihood of the text per language, its number of triples, and whether it fits a language."""
        found = triples(text)
        if not len(found):
            return np.zeros(len(self.languages)), 0, False
        logs = self.logs(found)
        return logs, len(found), self.fits(found, logs)

    def logs(self, found: np.ndarray) -> np.ndarray:
        used, times = _counted(found)
        at, reach = self.places(used)
        return len(found) * self.unseen + np.bincount(self.language[at], self.gain[at] * np.repeat(times, reach), minlength=len(self.languages))

    def fits(self, found: np.ndarray, logs: np.ndarray) -> bool:
        if np.isnan(self.level).all():  # no labelled text to compare with
            return True
        if (logs / len(found) >= self.bound(len(found))).any():
            return True
        pieces = np.array_split(found, max(1, round(len(found) / _PIECE)))
        fitting = sum(len(x) for x in pieces if (self.logs(x) / len(x) >= self.bound(len(x))).any())
        return len(pieces) > 1 and 2 * fitting >= len(found)

    def bound(self, n: int) -> np.ndarray:
        """The least mean log likelihood of a fitting text of ``n`` triples, per language (NaN: none fits)."""
        n = min(n, _PIECE) * _TRIPLE_WEIGHT
        usual = self.level - DEVIATIONS * np.sqrt(self.between + self.within / n)
        return np.maximum(usual, np.minimum(-np.log(BUCKETS), self.level) - DEVIATIONS / n)

    def without(self, found: np.ndarray, language: int) -> tuple[float, float]:
        """Mean and variance of the log likelihood per triple of a fitted text, with its own triples left out of the counts."""
        used, times = _counted(found)
        at, reach = self.places(used)
        mine = self.language[at] == language
        held = np.zeros(len(used))
        held[np.repeat(np.arange(len(used)), reach)[mine]] = self.n[at[mine]]
        logs = np.log((np.maximum(held - times, 0) + _SMOOTH) / (self.total[language] - len(found) + _SMOOTH * BUCKETS))
        mean = (logs * times).sum() / len(found)
        return mean, ((logs - mean) ** 2 * times).sum() / len(found)

    def places(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of these buckets are, one bucket after the other, and how many each has."""
        reach = self.starts[buckets + 1] - self.starts[buckets]
        return np.repeat(self.starts[buckets] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum()), reach


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets and how often each occurs."""
    if len(found) <= 2000:
        return np.unique(found, return_counts=True)
    seen = np.bincount(found, minlength=BUCKETS)
    used = np.flatnonzero(seen)
    return used, seen[used]


def language_code(name: Column) -> Column:
    """Lower case; of a two- or three-letter code only the language (en-US, EN and en_GB.UTF-8 are en). NULL for a name without letters or digits."""
    plain = F.lower(F.trim(name))
    code = F.regexp_extract(plain, r"^([a-z]{2,3})(?:[-_.@\s].*)?$", 1)
    return F.when(code != "", code).when(plain.rlike(r"[\p{L}\p{N}]"), plain)


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> TextModel:
    """Fit on (id, text, label): per label the ``train_rows`` rows with the smallest hash of the id.

    The sample is chosen on ids and labels alone; only its texts are read to the
    end. Its triples are counted by Spark and the counts, one per label and triple that
        occur together, come to the driver, as do the usual likelihood of each label's rows and
    how much it varies. Without any label the model has no language.
    """
    labelled = labelled.withColumn("label", language_code(F.col("label"))).filter("label is not null")
    keys = labelled.select("id", "label").withColumn("order", F.xxhash64("id", F.lit("language")))
    languages = sorted(r.label for r in keys.select("label").distinct().collect())
    # The limit on rows per label is applied by every task before rows move, and by salts before one task sees a label.
    chosen = first_per_group(keys, ["label"], [F.col("order"), F.col("id")], train_rows).select("id", "label").distinct()
    sample = labelled.join(keep_table(chosen, "language-sample"), ["id", "label"], "left_semi").select("text", "label")
    sample = keep_table(sample, "language-texts")
    places = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                keys = [triples(text or "") + places[label] * BUCKETS for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())]
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key // BUCKETS).astype(np.int32)), pa.array((key % BUCKETS).astype(np.int32)), pa.array(n)], names=["language", "bucket", "n"])

    rows = sample.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    model = TextModel(languages, *[rows.column(c).to_numpy() for c in ("language", "bucket", "n")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [(places[label], triples(text or "")) for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())]
                out = [(i, len(x), *model.without(x, i)) for i, x in found if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.float64()))], names=["language", "n", "mean", "var"])

    # Rows weigh by their triples; quartiles keep junk among the labelled rows from widening the bound.
    usual = sample.mapInArrow(compare, "language int, n long, mean double, var double").groupBy("language").agg(
        F.percentile("mean", [0.25, 0.5], F.col("n")).alias("q"), (F.sum("var") / F.sum("n") / _TRIPLE_WEIGHT).alias("noise"), (F.sum(F.col("var") * F.col("n")) / F.sum("n")).alias("within"),
    ).collect()
    model.level, model.between, model.within = (np.full(len(languages), np.nan) for _ in range(3))
    for r in usual:
        spread = ((r.q[1] - r.q[0]) / 0.6745) ** 2 - r.noise
        model.level[r.language], model.between[r.language], model.within[r.language] = r.q[1], max(spread, 0.01), max(r.within, 1.0)
    return model


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, parent domain and suffix of an address; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def markup_language(html: Column) -> Column:
    """The language that a page's first html tag declares; NULL where it declares none."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*)>", 1)
    name = F.regexp_extract(tag, r"""(?i)(?:^|\s)lang\s*=\s*["']?([A-Za-z]{2,8})""", 1)
    return F.when(name != "", F.lower(name))


def markup_text(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    return F.regexp_replace(bare, r"\s+", " ")


def identify(
    rows: DataFrame, model: TextModel, host_weight: float = HOST_WEIGHT, least_posterior: float = 0.5, least_triples: int = 1,
) -> DataFrame:
    """(id, text, declared, host, domain, suffix) -> id, language, posterior, text_language, n_triples, kept.

    ``kept`` is false for a text without ``least_triples`` letter triples (NULL, empty,
    signs only), where the text fits no label (another language, letters at random) and
    where no language reaches ``least_posterior``. Missing evidence
    (NULL) says nothing: without a host the domain's prior counts, and so on up
    to that of all rows. Declared languages that the model does not know count as one
    more kind. Equal posteriors are decided by the order of names. Every row gives
    one row, repeated ones too. A model without languages gives none (NULL, as is the
    posterior) and cannot reject any: every text with enough triples is kept.
    """
    languages, n = model.languages, len(model.languages)
    code_of = {name: i for i, name in enumerate(languages)}
    evidence = rows.select("id", F.col("text").cast("string").alias("text"), language_code(F.col("declared").cast("string")).alias("declared"), *[F.col(c).cast("string").alias(c) for c in ("host", "domain", "suffix")])
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, n, "text"):
            found = [model.score(t or "") for t in batch.column("text").to_pylist()]
            logs = np.array([f[0] for f in found]).reshape(len(found), n) * _TRIPLE_WEIGHT
            logs -= logs.max(axis=1, keepdims=True, initial=-np.inf)
            shares = np.exp(logs)
            shares /= shares.sum(axis=1, keepdims=True)
            near = logs > -_FAR
            ends = pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.nonzero(near)[1].astype(np.int32), logs[near], shares[near])]
            code = [None if d is None else code_of.get(d, n) for d in batch.column("declared").to_pylist()]
            kept = [batch.column(c) for c in ("id", "host", "domain", "suffix")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code, pa.int32()), *lists, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.bool_())], names=["id", "host", "domain", "suffix", "code", "langs", "logs", "shares", "n_triples", "fits"])

    scored = evidence.mapInArrow(score, f"id {kind}, host string, domain string, suffix string, code int, langs array<int>, logs array<double>, shares array<double>, n_triples long, fits boolean")
    enough = F.col("n_triples") >= least_triples
    if not n:
        none = F.lit(None).cast("string")
        return scored.select("id", none.alias("language"), none.cast("double").alias("posterior"), none.alias("text_language"), "n_triples", enough.alias("kept"))
    scored = keep_table(scored.withColumn("enough", enough).withColumn("weighs", enough & F.col("fits")), "language-scores")
    # Shares of 0 add nothing to a sum.
    shared = scored.filter("weighs").select("code", "host", "domain", "suffix", F.explode(F.arrays_zip("langs", "shares")).alias("x")).select("code", "host", "domain", "suffix", F.col("x.langs").alias("lang"), F.col("x.shares").alias("share")).filter("share > 0")
    total = F.sum("share").alias("n")
    found = shared.groupBy("code", "lang").agg(total).toArrow()
    codes, langs, sums = (found.column(c).to_numpy() for c in ("code", "lang", "n"))
    grand = np.bincount(langs, sums, minlength=n)
    base = (grand + 1.0) / (grand.sum() + n)
    stated = ~np.isnan(codes)
    says = {int(c): (langs[codes == c], sums[codes == c]) for c in np.unique(codes[stated])}
    norm = np.log(np.bincount(langs[stated], sums[stated], minlength=n) + 0.5 * (n + 1))

    joined = scored
    levels = ("suffix", "domain", "host")
    for level in levels:
        counts = shared.filter(F.col(level).isNotNull()).groupBy(level, "lang").agg(total).groupBy(level).agg(F.collect_list(F.struct("lang", "n")).alias("x"))
        counts = counts.select(F.col(level).alias(f"{level}_key"), F.col("x.lang").alias(f"{level}_langs"), F.col("x.n").alias(f"{level}_n"))
        counts = keep_table(counts, f"language-{level}s")  # of a size that Spark knows: while it is small, the rows stay where they are
        joined = joined.join(counts, F.col(level) == F.col(f"{level}_key"), "left")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, n):
            weighs = batch.column("weighs").to_numpy(zero_copy_only=False)
            own = _spread(batch, "langs", "shares", n) * weighs[:, None]
            logs = _spread(batch, "langs", "logs", n, -np.inf)
            prior = np.repeat(base[None], batch.num_rows, axis=0)
            for level in levels:
                there = batch.column(f"{level}_n").is_valid().to_numpy(zero_copy_only=False)
                if there.any():
                    others = np.maximum(_spread(batch, f"{level}_langs", f"{level}_n", n)[there] - own[there], 0.0)
                    prior[there] = (others + host_weight * prior[there]) / (others.sum(axis=1, keepdims=True) + host_weight)
            fused = logs + np.log(prior)
            code = batch.column("code").fill_null(-1).to_numpy()
            for c in np.unique(code[code >= 0]):
                told = np.full(n, 0.5)
                at, value = says.get(int(c), ([], []))
                told[at] += value
                fused[code == c] += np.log(told) - norm
            top = fused.argmax(axis=1)
            posterior = 1 / np.exp(fused - fused.max(axis=1, keepdims=True)).sum(axis=1)
            names = pa.array(languages, pa.string())
            text = pa.array(logs.argmax(axis=1), mask=~batch.column("enough").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), names.take(pa.array(top)), pa.array(posterior), names.take(text), batch.column("n_triples"), batch.column("weighs")], names=["id", "language", "posterior", "text_language", "n_triples", "weighs"])

    lists = [f"{level}_{c}" for level in levels for c in ("langs", "n")]
    out = joined.select("id", "code", "langs", "logs", "shares", "n_triples", "enough", "weighs", *lists)
    out = out.mapInArrow(fuse, f"id {kind}, language string, posterior double, text_language string, n_triples long, weighs boolean").withColumn("posterior", F.round("posterior", 6))
    return out.select("id", "language", "posterior", "text_language", "n_triples", (F.col("weighs") & (F.col("posterior") >= least_posterior)).alias("kept"))


def _parts(batches: Iterator[pa.RecordBatch], n: int, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices whose tables of rows and languages are of bounded size."""
    step = max(1, _CELLS // max(1, n))
    for whole in batches:
        for batch in slices(whole, text) if text else [whole]:
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def _spread(batch: pa.RecordBatch, langs: str, values: str, n: int, other: float = 0.0) -> np.ndarray:
    """Rows of languages and their values as a table with a column for every language."""
    table = np.full((batch.num_rows, n), other)
    reach = pc.fill_null(pc.list_value_length(batch.column(langs)), 0).to_numpy()
    table[np.repeat(np.arange(batch.num_rows), reach), batch.column(langs).flatten().to_numpy()] = batch.column(values).flatten().to_numpy()
    return table


def document_evidence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", source: str = "source") -> DataFrame:
    """Documents as ``identify`` reads them: the source takes the host's place."""
    none = F.lit(None).cast("string")
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{declared}`").alias("declared"), F.col(f"`{source}`").alias("host"), none.alias("domain"), none.alias("suffix"))


def page_evidence(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Web pages as ``identify`` reads them."""
    host, domain, suffix = host_parts(F.col(f"`{url}`").cast("string"))
    value = F.col(f"`{html}`").cast("string")
    return pages.select(F.col(f"`{page_id}`").alias("id"), markup_text(value).alias("text"), markup_language(value).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))


def labelled_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
