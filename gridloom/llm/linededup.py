"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A text is parted at newlines. A chunk ends where a rolling hash (cyclic polynomial) over the hashes
of ``WINDOW`` lines is smaller than at both neighbours, so inserted or removed lines shift no
boundary beyond their neighbourhood, and chunks have three lines on average and two at least; a line of ``PASSAGE`` words or more is a chunk of its own. Chunks of
several lines, and passages, that occur more than once in the corpus are compared byte by byte with
their first occurrence (smallest doc_id, then position) and removed where they are equal to it.

Chunks lose the ends of a repeated passage, and short ones whole. So a second, overlapping level takes
each shortest run of lines of ``PASSAGE`` words or more, from every line on and back from every line:
together they cover each line of any passage of so many words. Only runs whose hashes repeat are made as texts, and these too
are compared byte by byte with their first occurrence. Words are parted by the six ASCII characters of white space on both levels.

Null texts stay null and empty ones empty. Chunks of blank lines stay. Rows with equal doc_id
and text count as one document: repeated rows keep the same chunks. Of equal chunks the one of the smallest doc_id,
then position, stays. A null doc_id sorts first. Texts of any length are read whole; an empty table gives no
rows; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize

WINDOW, PASSAGE = 2, 50
#: Repeated chunks of which hashes and places (six numbers) are broadcast at most; beyond, the join is shuffled, without texts, and a frequent chunk is split by AQE.
BROADCAST_ROWS = 500_000
#: Bytes of removed line numbers that are broadcast at most; beyond, texts are shuffled to them.
BROADCAST_BYTES = 32 << 20
#: Occurrences of one chunk that are compared in a task; more are dealt over several keys.
SPLIT = 1000

KEY = ["doc_id", "digest"]


def line_hash(line: Column) -> Column:
    """32 bits of a line, alike in any SQL engine."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def is_passage(line: Column) -> Column:
    return (F.length(line) >= 2 * PASSAGE - 1) & (n_words(line) >= PASSAGE)


def is_blank(line: Column) -> Column:
    return ~F.rlike(line, F.lit(r"[^ \t\r]"))


def with_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, marks): of each line its hashes, whether it is a passage and whether it is blank."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.split("text", "\n", -1).alias("lines"))
    return lines.select(*KEY, F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), F.xxhash64(x).alias("g"), is_passage(x).alias("p"), is_blank(x).alias("b"))).alias("marks"))


def rolled(marks: Column, i: Column) -> Column:
    """Cyclic polynomial of the hashes of the window that ends at line i, 32 bits."""
    parts = []
    for back in range(WINDOW):
        h = F.get(marks, i - back)["h"]
        parts.append(F.when(i < back, 0).otherwise(F.shiftleft(h, back).bitwiseAND(0xFFFFFFFF).bitwiseOR(F.shiftright(h, 32 - back) if back else F.lit(0))))
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, start, n, h1, h2): the chunks that may be removed if they repeat."""
    rolls = with_lines(docs).withColumn("rolls", F.transform("marks", lambda x, i: rolled(F.col("marks"), i)))

    def lowest(r: Column, i: Column) -> Column:
        beside = [F.get(F.col("rolls"), i - 1), F.get(F.col("rolls"), i + 1)]
        return F.coalesce((r < beside[0]) & (r < beside[1]), F.lit(False))

    alone = lambda i: F.get(F.col("marks"), i)["p"] | F.coalesce(F.get(F.col("marks"), i + 1)["p"], F.lit(True))
    ends = rolls.select(*KEY, "marks", F.filter(F.transform("rolls", lambda r, i: F.when(alone(i) | lowest(r, i), i)), lambda x: x.isNotNull()).alias("ends"))
    spans = F.transform("ends", lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get(F.col("ends"), k - 1) + 1).alias("start"), e.alias("end")))
    eligible = F.filter(spans, lambda s: (s["end"] > s["start"]) | F.get(F.col("marks"), s["end"])["p"])
    rows = ends.select(*KEY, "marks", F.explode(eligible).alias("s")).select(*KEY, F.col("s.start").alias("start"), (F.col("s.end") - F.col("s.start") + 1).alias("n"), "marks")
    run = F.slice("marks", F.col("start") + 1, F.col("n"))
    rows = rows.where(F.exists(run, lambda x: ~x["b"]))
    return rows.select(*KEY, "start", "n", F.xxhash64(F.transform(run, lambda x: x["g"])).alias("h1"), F.xxhash64(F.transform(run, lambda x: x["h"])).alias("h2"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, start, n, h1, h2): the shortest runs of PASSAGE words or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.split("text", "\n", -1).alias("lines"))
    hashes = [F.transform("lines", lambda x: F.xxhash64(x)).alias("gs"), F.transform("lines", lambda x: F.hash(x)).alias("hs")]
    owners = F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, n_words(x))))  # the line of each word
    words = lines.select(*KEY, *hashes, owners.alias("owners")).where(F.size("owners") >= PASSAGE)
    at = lambda k: F.get(F.col("owners"), k)
    heads = F.filter(F.sequence(F.lit(0), F.size("owners") - 1), lambda k: (k == 0) | (at(k) != at(k - 1)))
    words = words.select(*KEY, "gs", "hs", "owners", heads.alias("heads"))
    run = lambda a, b: F.when((a >= 0) & (b < F.size("owners")), F.struct(at(a).alias("start"), (at(b) - at(a) + 1).alias("n")))
    ahead = F.transform("heads", lambda k: run(k, k + (PASSAGE - 1)))
    back = F.transform("heads", lambda k: run(k - PASSAGE, k - 1))  # ends before the line of this word
    last = F.array(run(F.size("owners") - PASSAGE, F.size("owners") - 1))
    runs = F.array_distinct(F.filter(F.concat(ahead, back, last), lambda r: r.isNotNull()))
    rows = words.select(*KEY, "gs", "hs", F.explode(runs).alias("s")).select(*KEY, F.col("s.start").alias("start"), F.col("s.n").alias("n"), "gs", "hs")
    return rows.select(*KEY, "start", "n", *[F.xxhash64(F.slice(c, F.col("start") + 1, F.col("n"))).alias(h) for h, c in (("h1", "gs"), ("h2", "hs"))])


def repeats(parts_of: Callable[[DataFrame], DataFrame], docs: DataFrame, level: int) -> DataFrame:
    """(doc_id, digest, start, n, h1, h2, parts, lead, skip, level) of a level's chunks whose hashes stand more than once.

    lead: it is the first one. skip: the lines of one that overlaps its own first occurrence. parts: over how many keys the copies are dealt.
    """
    narrow = materialize(parts_of(docs), "lines-chunks")
    first = F.min(F.struct("doc_id", "start", "digest")).alias("first")
    known = materialize(narrow.groupBy("h1", "h2").agg(F.count("*").alias("copies"), first).where("copies > 1"), "lines-repeats")
    places = known.select("h1", "h2", "first", F.ceil(F.col("copies") / SPLIT).cast("int").alias("parts"))
    if known.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    lead = F.struct("doc_id", "start", "digest").eqNullSafe(F.col("first"))
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest"))
    skip = F.when(own, F.greatest(F.lit(0), F.col("first.start") + F.col("n") - F.col("start"))).otherwise(0)
    return narrow.join(places, ["h1", "h2"]).select(*narrow.columns, "parts", lead.alias("lead"), skip.alias("skip"), F.lit(level).alias("level"))


def repeated_spans(levels: Callable[[DataFrame], DataFrame] | tuple[Callable[[DataFrame], DataFrame], ...], docs: DataFrame) -> DataFrame:
    """(doc_id, digest, start, n) of the chunks to remove: equal to an earlier one of their level.

    Texts of chunks are made only where hashes repeat: texts meet the places of their repeated chunks in one shuffle.
    """
    levels = levels if isinstance(levels, tuple) else (levels,)
    hits = reduce(DataFrame.unionByName, [repeats(parts_of, docs, k) for k, parts_of in enumerate(levels)])
    fields = ["start", "n", "h1", "h2", "parts", "lead", "skip", "level"]
    held = materialize(hits.groupBy(*KEY).agg(F.collect_set(F.struct(*fields)).alias("_hits")), "lines-hits")  # of one document
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    texts = texts.join(held, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("digest")))
    each = texts.select(*KEY, F.split("text", "\n", -1).alias("lines"), F.explode("_hits").alias("s")).select(*KEY, "lines", "s.*")
    found = each.select(*KEY, *fields, F.array_join(F.slice("lines", F.col("start") + 1, F.col("n")), "\n").alias("chunk"))
    found = materialize(found, "lines-found")
    key = ["level", "h1", "h2"]
    later = found.where("NOT lead").withColumn("part", F.pmod(F.xxhash64(*KEY, "start"), F.col("parts")).cast("int"))
    firsts = found.where("lead").dropDuplicates(key).select(*key, F.col("chunk").alias("original"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pair = later.join(firsts, [*key, "part"]).where(F.col("chunk") == F.col("original"))
    return pair.select(*KEY, (F.col("start") + F.col("skip")).alias("start"), (F.col("n") - F.col("skip")).alias("n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks and passages taken from ``text``, and ``n_lines`` and ``n_removed_lines`` (long).

    Columns of docs that are already named so are replaced.
    """
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed_lines")]
    spans = repeated_spans((chunks, passages), docs).groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("_spans"))
    gone = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    spans = materialize(spans.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), gone.alias("_gone")), "lines-gone")
    if (spans.agg(F.sum(F.size("_gone") * 4 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    rows = docs.select(*own, F.col("text").alias("_text"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    both = rows.join(spans, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_digest")), "left")
    both = both.select(*own, "_text", "_gone", F.split("_text", "\n", -1).alias("_lines"))
    numbers = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(numbers, "_gone"), lambda i: F.get(F.col("_lines"), i))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    return both.select(*own, text.alias("text"), n_lines.alias("n_lines"), removed.alias("n_removed_lines"))


#: The same rows in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
m AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS c, c >= 50 AS p FROM l),
rl AS (SELECT *, xor(h, coalesce(((lag(h) OVER w) << 1) % 4294967296 + ((lag(h) OVER w) >> 31), 0)) AS r FROM m WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
c AS (SELECT *, p OR coalesce(lead(p) OVER w, true) OR coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, false) AS cut FROM rl WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
ch AS (SELECT doc_id, text, k, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk, bool_or(p) AS p FROM k GROUP BY doc_id, text, k),
gone AS (SELECT doc_id, text, k FROM ch WHERE (n > 1 OR p) AND regexp_matches(chunk, '[^ \n\t\r]') QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) > 1),
wl AS (SELECT doc_id, text, i, coalesce(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS b, sum(c) OVER (PARTITION BY doc_id, text) AS t, c FROM m WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
en AS (SELECT doc_id, text, unnest([a, a - 50, t - 50]) AS f FROM wl WHERE c > 0),
ru AS (SELECT DISTINCT f.doc_id, f.text, f.i AS start, g.i - f.i + 1 AS n FROM (SELECT DISTINCT * FROM en) e JOIN wl f ON f.doc_id = e.doc_id AND f.text = e.text AND f.a <= e.f AND e.f < f.b JOIN wl g ON g.doc_id = e.doc_id AND g.text = e.text AND g.a <= e.f + 49 AND e.f + 49 < g.b),
pa AS (SELECT r.doc_id, r.text, start, n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM ru r JOIN m ON m.doc_id = r.doc_id AND m.text = r.text AND i >= start AND i < start + n GROUP BY ALL),
pf AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(start) OVER w AS fs, row_number() OVER w AS r FROM pa WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, start)),
gl AS (SELECT doc_id, text, i FROM k JOIN gone USING (doc_id, text, k) UNION SELECT doc_id, text, unnest(range(start + CASE WHEN fd = doc_id THEN greatest(0, fs + n - start) ELSE 0 END, start + n)) FROM pf WHERE r > 1),
kept AS (SELECT doc_id, text, count(*) AS n_lines, count(g.i) AS n_removed_lines, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.i IS NULL) AS rest FROM k LEFT JOIN gl g USING (doc_id, text, i) GROUP BY doc_id, text)
SELECT doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(rest, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines
FROM documents LEFT JOIN kept USING (doc_id, text)
"""
