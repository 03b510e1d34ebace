import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import ann, bpe, common, jaccard, linededup, ngrams, packing, pii, quality, queries, rules, sharding, toxicity
from gridloom.llm.common import code_points, utf8_parts
from tests.llm.cases import LONG, ROWS, no_docs, odd_docs


@pytest.fixture(scope="module")
def lib():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


# ---- sharding

def brute_capacity(sizes, shards):
    """Least capacity over all ways to cut, by dynamic programming."""
    best = [[float("inf")] * (shards + 1) for _ in range(len(sizes) + 1)]
    best[0][0] = 0
    for i in range(1, len(sizes) + 1):
        for k in range(1, shards + 1):
            total = 0
            for j in range(i - 1, -1, -1):
                total += sizes[j]
                best[i][k] = min(best[i][k], max(best[j][k - 1], total))
    return min(best[-1][1:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    assert sharding.smallest_capacity(sizes, shards) == brute_capacity(sizes, shards)


def test_planned_cuts_are_those_of_single_atoms(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 4)
    monkeypatch.setattr(sharding, "STEP_BITS", 3)
    rng = random.Random(3)
    atoms = sorted((rng.randrange(1 << sharding.KEY_BITS), rng.randint(1, 100)) for _ in range(400))
    atoms[7] = (atoms[7][0], 9000)
    large, firsts = sharding.plan_cuts(spark.createDataFrame(atoms, "key long, bytes long"), 6)
    rest = [a for a in atoms if a[0] not in large]
    assert large == [atoms[7][0]]
    capacity = sharding.smallest_capacity([s for _, s in rest], 5)
    load = Counter()
    for key, size in rest:
        load[sum(f <= key for f in firsts)] += size
    assert max(load.values()) == capacity and len(load) == 5


def test_shards_of_documents(spark, sf_dir):
    rows = queries.op2_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
        by_text[docs[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_documents(spark):
    rows = sharding.shard(odd_docs(spark), 3).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (1, 2)} == {16}
    assert sharding.shard(no_docs(spark), 3).count() == 0


# ---- packing

def test_window_filled_as_well_as_can_be():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        window = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill_window(window, counts)
        assert all(k <= counts[length] for length, k in chosen)
        assert sum(length * k for length, k in chosen) == max(s for s in sums if s <= window)


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(30)}
    table = packing.places(packing.plan_patterns(counts, 64))
    load, spots = Counter(), set()
    for length, n in counts.items():
        rows = table[table[:, 0] == length]
        for rank in range(n):
            _, first, sequence, copies, offset = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
            at = (int(sequence + (rank - first) // copies), int(offset + (rank - first) % copies * length))
            assert at not in spots
            spots.add(at)
            load[at[0]] += length
    assert max(load.values()) <= 64
    least = max(sum(k * v for k, v in counts.items()) / 64, sum(v for k, v in counts.items() if k > 32))
    assert len(load) <= 1.06 * least + 2


def check_packing(rows, texts, lib):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packed_documents(spark, sf_dir, lib):
    rows = queries.op4_packing(spark, sf_dir).collect()
    check_packing(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}, lib)
    used = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) * 1024 < 1.05 * used


def test_packing_odd_documents(spark, lib):
    rows = packing.pack(odd_docs(spark).where("doc_id <> 5 OR doc_id IS NULL"), 1024, 0).collect()
    check_packing(rows, {i: t for i, t in ROWS if i != 5}, lib)
    assert packing.pack(no_docs(spark)).count() == 0
    assert packing.pack(odd_docs(spark)).count() == len(rows) + 2


# ---- BPE

def test_every_character_is_split_alike(lib):
    own = bpe.ByteBPE(bpe.default_path())
    for point in range(bpe.AGREED + 1):
        text = f"a{chr(point)}b {chr(point)}1{chr(point)}{chr(point)} '{chr(point)}s"
        assert own.fast.encode_ordinary(text) == lib.encode(text, add_special_tokens=False).ids, hex(point)


def test_every_entry_is_the_result_of_its_own_merges(lib):
    own = bpe.ByteBPE(bpe.default_path())
    for i, piece in enumerate(own.pieces):
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        assert lib.encode(text, add_special_tokens=False).ids == [i]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t ab'stA9!?.\x1c\x85\xa0é中ア😀‍　", "<|endoftext|>", "'ll", " the", "''", "   "]), max_size=60))
def test_encoding_and_decoding_like_the_library(lib, parts):
    own, text = bpe.ByteBPE(bpe.default_path(), long=8), "".join(parts)
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode_bytes(ids).decode() == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["aabcthein", "aé中😀b", "0123456789", "!?*", " \n"])
def test_long_unsplit_texts_by_tree(lib, alphabet):
    rng = random.Random(alphabet)
    own = bpe.ByteBPE(bpe.default_path(), long=32)
    for n in (31, 33, 200, 5000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_digests_of_documents(spark, lib):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd_docs(spark)).collect()}
    want = set()
    for i, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows == want
    assert bpe.encode_documents(no_docs(spark)).count() == 0


# ---- classifiers

def held_out(spark, sf_dir, found, label):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return found.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("label")).toPandas()


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, sf_dir)
    assert found.count() == 10_000
    t = held_out(spark, sf_dir, found, "toxic")
    assert ((t.predicted == 1) & (t.label == 0)).sum() <= 0.01 * (t.label == 0).sum()
    assert t[t.label == 1].predicted.mean() > 0.6
    assert t.score.between(0, 1).all()


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    t = held_out(spark, sf_dir, queries.op10_quality(spark, sf_dir), "quality")
    assert t[t.label == 1].predicted.mean() > 0.99
    assert t[t.label == 0].predicted.mean() < 0.1


def test_classifiers_of_odd_documents(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (7, None), (99, 1)], "doc_id long, label int")
    model = toxicity.fit(odd_docs(spark), labels)
    rows = toxicity.score(odd_docs(spark), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(odd_docs(spark), labels.where("label = 5"))
    assert {round(r.score, 6) for r in toxicity.score(odd_docs(spark), none).collect()} == {0.0}
    assert toxicity.score(no_docs(spark), model).count() == 0
    vectors = quality.featurize(odd_docs(spark))
    fitted = quality.fit(vectors, labels.select("doc_id"))
    assert len(quality.score(vectors, fitted).collect()) == len(ROWS)
    assert {r.score for r in quality.score(vectors, quality.fit(vectors, labels.where("label = 5"))).collect()} == {0.0}
    assert quality.fit(quality.featurize(no_docs(spark)), labels).prior == 0


def test_non_negative_risk_is_minimal():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (400, 3)), np.vstack([rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (700, 3))])
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (p, u))
    sp, su = p.T @ p / len(p), u.T @ u / len(u)

    def risk(w, prior):
        loss = lambda x, y: ((1 - y * (x @ w)) ** 2 / 4).mean()
        return prior * loss(p, 1) + max(0, loss(u, -1) - prior * loss(p, -1)) + 5e-5 * w @ w

    for prior in (0.3, 0.95):
        w = quality.solve(su, sp, prior, 1e-4)
        assert all(risk(w, prior) <= risk(w + d, prior) + 1e-9 for d in rng.normal(0, 0.02, (300, 4)))


def test_prior_from_tails():
    rng = np.random.default_rng(1)
    p = np.histogram(rng.beta(8, 2, 20_000), 1000, (0, 1))[0]
    u = np.histogram(np.concatenate([rng.beta(8, 2, 30_000), rng.beta(2, 8, 20_000)]), 1000, (0, 1))[0]
    assert abs(quality.estimate_prior(u, p) - 0.6) < 0.05


# ---- pseudonyms

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=2, max_size=12))
def test_feistel_is_a_permutation_of_the_format(digits):
    forth, back = pii.Feistel(b"k"), pii.Feistel(b"k", True)
    new = forth.symbols("card", digits, [10] * len(digits))
    assert back.symbols("card", new, [10] * len(digits)) == digits


def test_feistel_covers_a_small_range():
    net = pii.Feistel(b"k")
    assert sorted(net.below("x", v, 97) for v in range(97)) == list(range(97))


TEXT = 'Ann ann.lee@mail7.example.com, +1 (017) 555-7713, card 4929348385146306 or 4929-3483-8514-6306, ip 97.51.17.173. SSN 123-45-6789 on 2021-03-04, 4/3/2021, 12/25/1999; GB82 WEST 1234 5698 7654 32 token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'


def test_pseudonyms_keep_formats_and_links():
    names = pii.Pseudonymizer(b"k")
    new, found = names.replace(TEXT)
    assert Counter(k for _, _, k, _ in found) == {"email": 1, "phone": 1, "card": 2, "ip": 1, "ssn": 1, "date": 3, "iban": 1, "secret": 1}
    for start, end, _, value in found:
        assert TEXT[start:end] not in new and value in new
    cards = [v.replace("-", "") for _, _, k, v in found if k == "card"]
    assert cards[0] == cards[1] and pii.luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert pii.iban_rest("".join(v for _, _, k, v in found if k == "iban").replace(" ", "")) == 1
    dates = [v for _, _, k, v in found if k == "date"]
    assert dates[0].split("-")[0] == dates[1].split("/")[-1] and int(dates[0].split("-")[2]) == int(dates[1].split("/")[0])
    assert pii.Pseudonymizer(b"k", True).replace(new)[0] == TEXT
    assert pii.Pseudonymizer(b"other").replace(TEXT)[0] != new


def test_invalid_numbers_stay():
    text = "4929348385146307 999.1.1.1 2021-02-30 000-12-3456 version 2.0. call 12 or 1234 5678"
    assert pii.Pseudonymizer(b"k").replace(text) == (text, [])


def test_pseudonyms_of_odd_documents(spark):
    rows = pii.pseudonymize(odd_docs(spark), b"k").collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(ROWS, key=repr)
    assert all(r.found == [] and r.score == "x" for r in rows)
    assert pii.pseudonymize(no_docs(spark), b"k").count() == 0


# ---- quality rules, line dedup: SQL on the small tables

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_rules_of_odd_documents(spark):
    trusted = spark.createDataFrame([(3,), (None,)], "doc_id long")
    weights = rules.fit(odd_docs(spark), trusted)
    rows = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in rules.apply_rules(odd_docs(spark), weights).collect()}
    assert (1, 0, True, False) in rows and (7, 3001, True, False) in rows
    assert rules.apply_rules(no_docs(spark), rules.fit(no_docs(spark), trusted)).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 100])
def test_every_trusted_row_counts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_ROWS", broadcast, raising=False)
    docs = spark.range(20_400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    assert not rules.fit(docs, docs).any()  # trusted and raw are the same


def test_base_counts():
    assert rules.base_counts("a b c a b c x\n#x\n#x\n\n") == (9, 11, 2, 1, 6)
    assert rules.base_counts("") == (0, 0, 0, 0, 0)


def test_lines_of_odd_documents(spark):
    rows = {(r.doc_id, r.n_lines, r.n_removed_lines) for r in linededup.dedup_lines(odd_docs(spark)).collect()}
    assert (1, 0, 0) in rows and (2, 1, 0) in rows and (4, 3, 0) in rows
    assert linededup.dedup_lines(no_docs(spark)).count() == 0


def test_repeated_passages_go_but_the_first(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, block = words(60), "\n".join(words(9) for _ in range(12))
    docs = [(i, f"{words(20)}\n{passage}\n{words(11)}") for i in range(5)] + [(10 + i, f"{words(8)}\n{words(7)}\n{block}\n{words(6)}") for i in range(3)] + [(20, words(30) + "\n" + words(30))]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    assert out[0] == texts[0] and out[10] == texts[10] and out[20] == texts[20]
    assert all(passage not in out[i] for i in range(1, 5))
    assert all(block not in out[10 + i] and len(out[10 + i]) < 0.6 * len(texts[10 + i]) for i in (1, 2))
    assert all(set(out[i].split("\n")) <= set(texts[i].split("\n")) for i in texts)


@pytest.mark.parametrize("m", [2, 3, 4, 5, 8])
def test_passages_of_few_lines_go_whole(spark, m):
    rng = random.Random(m)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    around = lambda: [words(rng.randint(3, 12)) for _ in range(rng.randint(1, 6))]
    docs, passages = [], []
    for i in range(20):
        each = [50 // m + 1] * m if i % 2 else [40, *[3] * (m - 2), 13 + m]
        passages.append([words(n) for n in each])
        docs += [(2 * i, [*around(), *passages[i], *around()]), (2 * i + 1, [*around(), *passages[i], *around()])]
    rows = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in docs], "doc_id long, text string")
    out = {r.doc_id: r for r in linededup.dedup_lines(rows).collect()}
    for i, lines in docs:
        want = [x for x in lines if not i % 2 or x not in passages[i // 2]]
        assert out[i].text == "\n".join(want) and out[i].n_removed_lines == len(lines) - len(want)


def test_repeats_within_a_document_leave_their_first_passage(spark):
    lines = ["one two three four five six seven eight nine ten"] * 40
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["head", *lines, "tail"]))], "doc_id long, text string")
    spans = linededup.repeated_spans(linededup.passages, rows).collect()
    gone = {i: {k for r in spans if r.doc_id == i for k in range(r.start, r.start + r.n)} for i in (1, 2)}
    assert gone[1] == set(range(5, 40)) and gone[2] == set(range(1, 41))


# ---- Jaccard join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def joined(spark, rows):
    found = jaccard.join_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr)


def test_components_like_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(400)]
    texts = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + (" " + " ".join(vocabulary[:rng.randint(0, 30)]) if family % 2 else ""))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 4, 5, 6, 50)] + ["A b c D", "a B C d", "a b c d e"]
    rows = list(enumerate(texts)) + [(500, texts[0].upper()), (500, texts[0].upper()), (501, None), (502, ""), (503, " \n")]
    assert joined(spark, rows) == brute_components(rows)


def test_join_of_odd_documents(spark):
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_sets(odd_docs(spark)).collect()), key=repr) == brute_components(ROWS)
    assert jaccard.join_sets(no_docs(spark)).count() == 0
    kept = jaccard.drop_near_copies(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, None, 7, 8, 9, 10], key=repr)


def test_join_in_small_parts(spark, monkeypatch):
    """Long lists in chunk pairs, short blocks, pairs written early, many buckets: the components stay the same."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"u{k}_{i}" for i in range(13 + k % 4)]) for k in range(60)]
    texts += [" ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in passage + [f"c{i}" for i in range(40)]) for _ in range(70)]
    rows = list(enumerate(texts)) + [(900 + k, texts[3]) for k in range(40)]
    expected = brute_components(rows)
    assert len({c for _, _, c in expected}) > 3
    for name, value in (("BLOCK", 8), ("LIST", 10), ("HELD_PAIRS", 50), ("BUCKET_ENTRIES", 300), ("BROADCAST_IDS", 5), ("ROUNDS", 1), ("SEEDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    assert joined(spark, rows) == expected
    monkeypatch.setattr(jaccard, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    x = pa.array(["aa bb cc dd ee ff", "aa bb cc dd ee gg", "a b"], pa.large_string())
    sets, codes = jaccard.exact_sets(x)
    assert np.bincount(sets).tolist() == [2, 2, 1] and len(np.intersect1d(codes[sets == 0], codes[sets == 1])) == 1


def test_dropped_rows_of_equal_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "x y z w v u"), (None, "a b c d e f g"), (None, "q r s t u v"), (2, "q r s t u v"), (3, None)]
    kept = jaccard.drop_near_copies(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, _d1 string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a b c d e f g"), (1, "x y z w v u"), (2, "q r s t u v"), (3, None)], key=repr)
    assert kept.columns == ["doc_id", "text", "_d1"]


def test_bounds_of_linked_sets():
    for a in range(1, 60):
        for b in range(a, 75):
            need = next((i for i in range(a + 1) if 100 * i >= 80 * (a + b - i)), a + 1)
            assert need == jaccard.needed(a, b) or (need > a and jaccard.needed(a, b) > a)


# ---- nearest neighbours

def test_recall_against_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = ann.search(vectors, F.col("vec_id") % 20 == 0, 5).toPandas()
    pdf = vectors.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = u @ u[q]
        s[q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]])
        mine = found[found.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(mine.score) <= 0).all()
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], atol=1e-12)
        hits, total = hits + len(best & set(mine.vec_id)), total + 5
    assert hits / total >= 0.9


def test_an_outlier_gets_k_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.01, (40, 8)) + np.eye(8)[0]
    vectors[7] = np.eye(8)[1]
    centers = lambda x, k: x[[np.argmin(x @ x.mean(axis=0)), np.argmax(x @ x.mean(axis=0))]]  # noqa: E731  the outlier's and one of the others
    monkeypatch.setattr(ann, "kmeans", centers)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(df, F.lit(True), 5).collect())
    assert got == {i: 5 for i in range(40)}
    few = ann.search(df.where("vec_id < 10"), F.lit(True), 12).collect()
    assert Counter(r.query_id for r in few) == {i: 9 for i in range(10)}


def test_search_with_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [0.0, 2.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 0.0)]
    assert ann.search(df.where("vec_id = 3"), F.col("vec_id") % 50 == 0, 5).count() == 0


# ---- shared vector functions

@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=6))
def test_spans_are_the_words_of_each_text(texts):
    strings = pa.array(texts, pa.large_string())
    data, offsets = utf8_parts(strings)
    start, end, row = ngrams.spans(data, offsets, ngrams.SPACES)
    got = [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(start, end, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    points, ends = code_points(strings)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(ends, ends[1:])] == texts
    hashes = ngrams.span_hashes(data, start, end)
    assert len({h for h in hashes.tolist()}) == len({w for _, w in got})


def test_long_text_counts():
    assert rules.base_counts(LONG)[0] == 3001


@pytest.mark.parametrize("text", ["x" + " \n" * 600_000 + "y", "a  b" + " " * 300_000 + "c d", "w" * 300_000 + " v", "\u2003\t" * 9000 + "é" * 5000 + " 12" * 3000 + "!" * 5000, "p " * 9000 + "\xa0 " * 5000, " " * 4097, "\n" * 9000 + " q"])
def test_long_runs_like_the_library(lib, text):
    found = bpe.encoder(bpe.default_path()).encode(text)
    assert found == lib.encode(text, add_special_tokens=False).ids


def test_time_of_long_runs_grows_in_proportion():
    import time

    enc, took = bpe.encoder(bpe.default_path()), []
    for n in (200_000, 800_000):
        start = time.perf_counter()
        enc.encode("a" + " \n" * n + "b " + " " * n + "c" * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 1


def test_phones_and_emails_link_in_all_forms():
    names = pii.Pseudonymizer(b"k")
    digits = lambda t: "".join(c for c in t if c.isdigit())
    forms = ["+15551234567", "+1 555 123 4567", "+1-555-123-4567", "+1 (555) 123-4567"]
    assert len({digits(names.replace(f)[0]) for f in forms}) == 1 and digits(names.replace(forms[0])[0]) != "15551234567"
    assert names.replace("+44 20 7946 0958")[0].startswith("+44 ")
    a, b = (names.replace(f)[0] for f in ("Ann.Lee@Example.com", "ann.lee@example.com"))
    assert a.lower() == b and a[0].isupper() and a != "Ann.Lee@Example.com"
    back = pii.Pseudonymizer(b"k", restore=True)
    for f in [*forms, "+44 20 7946 0958", "Ann.Lee@Example.com", "ann.lee@example.com"]:
        assert back.replace(names.replace(f)[0])[0] == f


def test_days_link_in_all_layouts_and_come_back():
    names, back = pii.Pseudonymizer(b"k"), pii.Pseudonymizer(b"k", restore=True)
    for year in (1999, 2024):
        for month in range(1, 13):
            for day in (1, 5, 9, 10, 12, 13, 28):
                found = set()
                forms = [f"{year}-{month:02d}-{day:02d}", f"{year}/{month}/{day}", f"{day}/{month}/{year}", f"{day:02d}.{month:02d}.{year}", f"{day:02d}-{month}-{year}"]
                forms += [f"{month}/{day}/{year}", f"{month:02d}/{day:02d}/{year}"] if day > 12 else []
                for f in forms:
                    new = names.replace(f)[0]
                    assert back.replace(new)[0] == f and len(new) == len(f)
                    found.add(pii.date_of(pii._DATE.fullmatch(new))[0])
                assert len(found) == 1


def test_many_finds_take_no_square_time():
    import time

    start = time.perf_counter()
    text, found = pii.Pseudonymizer(b"k").replace(" ".join(f"10.{i // 250 % 250}.{i % 250}.7" for i in range(20_000)))
    assert len(found) == 20_000 and [f[0] for f in found] == sorted(f[0] for f in found) and time.perf_counter() - start < 20


def test_pseudonyms_of_documents_like_a_plain_loop(spark, sf_dir):
    names = pii.Pseudonymizer(queries.PUBLIC_KEY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, found = names.replace(texts[r.doc_id]) if texts[r.doc_id] is not None else (None, [])
        assert (r.text, r.n_replaced, [(f.kind, f.start, f.end) for f in r.found]) == (text, len(found), [(k, a, b) for a, b, k, _ in found])


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(7)]
    rows += [(200, [1e200, 2e200, 0.0, 0.0, 0.0, 1e190]), (201, [1e-200, 2e-200, 0.0, 0.0, 0.0, 0.0]), (300, None), (301, []), (302, [0.0] * 6), (303, [float("nan")] * 6), (304, [None] * 6), (None, [1.0] * 6)]
    rows += [(0, rows[0][1]), (5, rows[7][1])]  # repeated ids
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5, recall=1.0).toPandas()
    assert np.isfinite(found.score).all() and not set(found.query_id) & {300, 302} and not set(found.vec_id) & {301, 303, 304}
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q in {i for i, _ in good if i % 10 == 0}:
        best = {}
        for i, a in good:
            for j, b in good:
                if i == q and j != q and len(a) == len(b):
                    x, y = (np.array(v) / max(map(abs, v)) for v in (a, b))
                    best[j] = max(best.get(j, -2), float(x @ y / np.sqrt((x @ x) * (y @ y))))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5]
        mine = found[found.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == [j for j, _ in want] and np.allclose(mine.score, [s for _, s in want], atol=1e-12)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_blocks_of_lists_change_nothing(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = ann.search(vectors, F.col("vec_id") % 20 == 0, 5, recall=1.0).collect()
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1)
    many = ann.search(vectors, F.col("vec_id") % 20 == 0, 5, recall=1.0).collect()
    key = lambda r: (r.query_id, r["rank"], r.vec_id, round(r.score, 12))
    assert sorted(map(key, one)) == sorted(map(key, many))


def test_a_chunk_of_very_many_texts(spark, monkeypatch):
    rows = [(i, f"head {i} of one\nshared line {'word ' * 60}end\ntail {i * 7} here") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    monkeypatch.setattr(linededup, "SPLIT", 3)
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == one
    assert "shared" in one[0] and sum("shared" in t for t in one.values()) == 1


def test_toxicity_of_few_labelled_rows(spark):
    rows = [(i, f"you are a vile {w}" if i % 2 else f"the garden has a {w}") for i, w in enumerate(["pig", "tree", "rat", "rose", "toad", "path"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("label")))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in (1, 3, 5)) > max(scores[i] for i in (0, 2, 4))


def test_list_blocks_and_early_writes(spark):
    """across() in blocks of four entries, writing after each ten pairs, counts what it counts at once."""
    rng = np.random.default_rng(8)
    n = rng.integers(20, 30, 40)
    head = np.zeros(40, jaccard.HEAD)
    head["set"], head["label"], head["n"], head["cap"] = np.arange(40), np.arange(40) % 9, n, n
    own, key = (a.ravel() for a in np.meshgrid(np.arange(40), np.arange(3), indexing="ij"))
    rank, rest = np.zeros(120, "<u4"), np.full(120, 28, "<u4")
    batch = pa.RecordBatch.from_pylist([{"deal": 0, "part": 0, "parts": 1, "block": 0, "heads": head.tobytes(), "own": own.astype("<u2").tobytes(), "key": key.astype("<u8").tobytes(), "rank": rank.tobytes(), "rest": rest.tobytes()}])

    def counted():
        out = Counter()
        for b in jaccard.across(iter([batch])):
            for r in b.to_pylist():
                out[r["a"], r["b"], r["na"], r["nb"]] += r["shared"]
        return out

    whole = counted()
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 9 != b % 9 and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])}
    assert {k[:2] for k in whole} == want and set(whole.values()) == {3}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "BLOCK", 4)
        patch.setattr(jaccard, "HELD_PAIRS", 10)
        assert counted() == whole


def plain_grams(text, n, bits):
    """Buckets of the n-grams of a text, one by one in Python's integers."""
    points = [ord(c.lower()) if len(c.lower()) == 1 and ord(c) < 0x10000 else ord(c) for c in text]
    out = set()
    for i in range(len(points) - n + 1):
        h = points[i]
        for p in points[i + 1 : i + n]:
            h = (h * 16777619 + p) % (1 << 32)
        h ^= h >> 15
        out.add(h * 2654435761 % (1 << 32) >> (32 - bits))
    return out


def test_toxicity_like_a_plain_fit(spark):
    """The query's scores from counts, ratios and a fit over every n-gram, text by text."""
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts and r.toxic is not None}
    grams = {i: {(k, b) for k, n in enumerate(toxicity.LENGTHS) for b in plain_grams(t, n, toxicity.BITS)} for i, t in texts.items()}
    n = [sum(v == c for v in labels.values()) for c in (0, 1)]
    counts = defaultdict(lambda: [0, 0])
    for i, c in labels.items():
        for g in grams[i]:
            counts[g][c] += 1
    least = min(4.0, 0.7 * (4 * n[0] * n[1] / (n[0] + n[1])) ** 0.5)
    kept = {}
    for g, (a, b) in counts.items():
        p = (a + b + 1) / (n[0] + n[1] + 2)
        if abs(b / n[1] - a / n[0]) / (p * (1 - p) * (1 / n[0] + 1 / n[1])) ** 0.5 >= least:
            kept[g] = np.log((b + 1) / (n[1] + 2)) - np.log((a + 1) / (n[0] + 2))
    names = {g: k for k, g in enumerate(sorted(kept))}
    ids = sorted(labels)
    pairs = [(r, names[g]) for r, i in enumerate(ids) for g in grams[i] if g in names]
    rows, cols = (np.array(x, int) for x in zip(*pairs))
    weights, intercept = toxicity.logistic(rows, cols, np.array([kept[g] for g in sorted(kept)]), np.array([labels[i] for i in ids], float), 1e-4, 400)
    found = {r.doc_id: r.score for r in queries.op1_toxicity(spark, sf_dir).collect()}
    assert set(found) == set(texts) and len(kept) > 10
    for i, g in grams.items():
        z = intercept + sum(weights[names[x]] for x in g if x in names)
        assert found[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_like_a_plain_fit(spark):
    """The query's scores from the vectors of single texts and moments summed in one place."""
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(texts)
    x = np.vstack([quality.features(pa.array([texts[i]], pa.large_string())) for i in ids]).astype(float)
    p = x[[i in trusted for i in ids]]
    su, sp, ridge = x.T @ x / len(x), p.T @ p / len(p), 1e-4
    tell = np.linalg.solve(su + sp + 2 * ridge * np.eye(quality.WIDTH), sp[-1] - su[-1])
    hist = [np.bincount(np.clip(((m @ tell + 1) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1), minlength=quality.BINS) for m in (x, p)]
    weights = quality.solve(su, sp, quality.estimate_prior(*hist), ridge)
    want = dict(zip(ids, np.clip((x @ weights + 1) / 2, 0, 1)))
    found = {r.doc_id: r.score for r in queries.op10_quality(spark, sf_dir).collect()}
    assert set(found) == set(want) and all(found[i] == pytest.approx(want[i], abs=1e-4) for i in ids)


def test_features_do_not_depend_on_the_batch():
    texts = [t or "" for _, t in ROWS] + ["a. b! c?\n" * 50, "|x|" * 999]
    whole = quality.features(pa.array(texts, pa.large_string()))
    assert all(np.array_equal(whole[k], quality.features(pa.array([t], pa.large_string()))[0]) for k, t in enumerate(texts))
    for size in (1, 40, 1 << 20):
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in ROWS], pa.string())})
        parts = list(common.slices(iter([batch]), size=size))
        assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and all(p.num_rows == 1 or p.column(0).nbytes < size + 200 for p in parts)


def test_settings_come_back(spark):
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ZeroDivisionError), common.small_batches(spark):
        assert int(spark.conf.get(key)) <= 512
        1 / 0
    assert spark.conf.get(key) == before


def test_words_of_passages_are_parted_by_white_space_alone(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    tabs, wide, joined = "\t".join(word() for _ in range(50)), "  ".join(word() for _ in range(30)), "\xa0".join(word() for _ in range(60))
    docs = [(i, f"{word()} head\n{line}\n{word()} tail") for i, line in enumerate((tabs, tabs, wide, wide, joined, joined))]
    out = {r.doc_id: r.n_removed_lines for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    spans = {(r.doc_id, r.start, r.n) for r in linededup.repeated_spans(linededup.passages, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert spans == {(1, 1, 1)}
