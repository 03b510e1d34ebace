"""Quality rules: base counts of words and repeats, and a hashed n-gram likelihood ratio.

Two multinomials over hashed character n-grams, one of trusted target texts and one of the raw
corpus (all documents), give each bucket a log-likelihood ratio. A text's verdict is its mean ratio
per n-gram against a fixed threshold, the same for every document. Weights are rounded to integers
so that sums don't depend on their order.

The target is every trusted row and the raw corpus every document. Null and empty texts have no words and fail the base rules; a text
without an n-gram has a ratio of 0. Without target texts all ratios are 0. A ratio equal to the threshold is
kept. Repeated rows count as often as they stand there and get equal verdicts; texts of any length are read whole. An
empty table gives no rows. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import code_points, slices, small_batches, text_array
from gridloom.llm.ngrams import gram_buckets, inside, owners

GRAM, BITS = 4, 16
#: Weights are integers in units of this.
UNIT = 1 << 20
#: A text with a smaller mean log-likelihood ratio goes.
THRESHOLD = -0.5
#: Trusted ids that are broadcast at most; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = " \t\n\x0b\x0c\r"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORD.findall(text)
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of a batch."""
    points, offsets = code_points(text_array(batch))
    ok = inside(offsets, GRAM)
    return owners(offsets)[: len(ok)][ok], gram_buckets(points, GRAM, BITS)[ok]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in slices(batches):
        trusted = batch.column(batch.schema.get_field_index("trusted")).to_numpy(zero_copy_only=False)
        row, bucket = grams(batch)
        raw += np.bincount(bucket, minlength=1 << BITS)
        target += np.bincount(bucket[trusted[row]], minlength=1 << BITS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer log-likelihood ratio of each bucket, counts smoothed by 1."""
    if not target.sum():
        return np.zeros(len(raw), np.int64)
    p = np.log(target + 1.0) - np.log(target.sum() + float(len(raw)))
    q = np.log(raw + 1.0) - np.log(raw.sum() + float(len(raw)))
    return np.floor((p - q) * UNIT + 0.5).astype(np.int64)


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Ratios from all documents and the ids of trusted ones."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("yes", F.lit(True))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    flagged = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("text", F.col("yes").isNotNull().alias("trusted"))
    with small_batches(docs.sparkSession):
        rows = flagged.mapInArrow(count_grams, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # 2 ** BITS rows at most
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return ratios(raw, target)


def judge(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, bucket = grams(batch)
            n = np.bincount(row, minlength=batch.num_rows)
            order = np.concatenate([[0], np.cumsum(n)])
            running = np.concatenate([[0], np.cumsum(weights[bucket])])  # integers: exact
            mean = (running[order[1:]] - running[order[:-1]]) / np.maximum(n, 1) / UNIT
            base = np.array([base_counts(t) for t in text_array(batch).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(mean)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    return apply


def apply_rules(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr) of every document."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = docs.select("doc_id", "text").mapInArrow(judge(weights), schema)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")


#: The same rules in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
often AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
u AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM d WHERE t <> ''),
c AS (SELECT doc_id, unicode(ch)::HUGEINT AS a, unicode(lead(ch, 1) OVER w) AS b, unicode(lead(ch, 2) OVER w) AS c, unicode(lead(ch, 3) OVER w) AS e FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, (((((a * 16777619 + b) % 4294967296) * 16777619 + c) % 4294967296) * 16777619 + e) % 4294967296 AS h FROM c WHERE e IS NOT NULL),
g AS (SELECT doc_id, (xor(h::BIGINT, h::BIGINT >> 15)::HUGEINT * 2654435761 % 4294967296)::BIGINT >> 16 AS bucket FROM h),
n AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM trusted)) AS target FROM g GROUP BY bucket),
r AS (SELECT bucket, CASE WHEN sum(target) OVER () = 0 THEN 0 ELSE floor((ln(target + 1.0::DOUBLE) - ln(sum(target) OVER () + 65536.0::DOUBLE) - (ln(raw + 1.0::DOUBLE) - ln(sum(raw) OVER () + 65536.0::DOUBLE))) * 1048576 + 0.5)::BIGINT END AS r FROM n),
s AS (SELECT doc_id, sum(r)::DOUBLE / count(*) / 1048576 AS llr FROM g JOIN r USING (bucket) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0) AS llr
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND llr >= -0.5 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
"""
