"""MinHash groups, collocations and fill-in-middle against plain Python, and samples of labelled rows that stay bounded."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F
from test_operators import SCHEMA, awkward_rows

from quillstrata.llm import collocations, infill, langid, minhash, toxicity
from quillstrata.llm.common import drawn
from quillstrata.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def awkward(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_minhash", "op12_collocations", "op13_fill_in_middle"])
def test_queries_match_their_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


# --- MinHash


def shingle_set(text):
    words = brute.words_of(brute.low(text))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def linked_groups(rows):
    """(key, size of the set, smallest key reachable) of every row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 80 * (len(a) + len(sets[j]) - shared):
                root[max(top(i), top(j))] = min(top(i), top(j))
    keys = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            keys[top(i)].append(k)
    return sorted(((k, len(s), min(keys[top(i)], default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def families(seed):
    """Texts that drift apart word by word, so that groups hang together by chains, and a passage that all share."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [draw.choice(vocabulary) for _ in range(25)]
    out = []
    for _ in range(10):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(2, 80))] + passage
        for _ in range(draw.randint(1, 14)):
            out.append((len(out), " ".join(words)))
            words = list(words)
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
    draw.shuffle(out)
    return out


def found_groups(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"part_members": 3}), (3, {"heavy_rows": 2, "rows": 2})])
def test_groups_are_those_of_all_pairs(spark, seed, options):
    rows = families(seed)
    assert found_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **options) == linked_groups(rows)


def test_groups_of_awkward_rows(awkward, rows, nothing, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_KEYS", 0)
    assert found_groups(awkward) == linked_groups([(r[0], r[1]) for r in rows])
    assert minhash.near_duplicates(nothing).count() == 0


def test_sketch_agreement_is_the_similarity():
    draw = np.random.default_rng(1)
    both = draw.integers(0, 1 << 63, 800, np.uint64)
    a, b = np.concatenate([both, draw.integers(0, 1 << 63, 100, np.uint64)]), np.concatenate([both, draw.integers(0, 1 << 63, 100, np.uint64)])
    sketcher = minhash.Sketcher(1, 2000)
    share = (sketcher.sketch(a) == sketcher.sketch(b)).mean()
    assert abs(share - 0.8) < 0.03
    sides = minhash.Sketcher(3, 20).sketch(a) & np.uint64(1)
    assert sides.tolist() == [0] * 20 + [1] * 20


def test_unit_forest_joins_what_is_similar_and_nothing_else():
    sets = [np.arange(0, 10), np.arange(1, 11), np.arange(2, 12), np.arange(50, 60), np.arange(0, 10)]
    links = minhash.unit_forest([s.astype(np.uint64) for s in sets], [b"a", b"b", b"c", b"d", b"a"], 80)
    assert len(links) == 2 and {v for link in links for v in link} <= {0, 1, 2, 4}


# --- collocations


def phrases_of(rows, max_words=3, least=10, percent=50, top=2000):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                count[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in kept.items():
            inside = [f2 for q, f2 in kept.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * v >= percent * a for v in inside):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def language_rows(seed, texts=120):
    draw = random.Random(seed)
    words = ["the", "New", "york", "stock", "Éa", "a", "é", "\U0001f600", "x\x1fy", "b" * 200]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "...", " ; "]
    rows = [("en", None), (None, ""), ("fr", " .,; "), ("en", "the " * 3000)]
    for _ in range(texts):
        text = "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "fr", None, "und"]), text + " new york stock"))
    return rows


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, dict(ROW_WORDS=7, TASK_WORDS=50, TALLY_ROWS=5, HELD_ROWS=3, GROUP_HASHES=64, COUNTED_WORDS=1))])
def test_phrases_are_those_of_a_plain_count(spark, monkeypatch, seed, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(collocations, name, value)
    rows = language_rows(seed)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("clash")).withColumn("code", F.lit(1)).repartition(3)
    ranked = 5 if sizes else collocations.RANKED
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(df, ranked=ranked, top=40).collect())
    assert got == phrases_of(rows, top=40) and len(got) > 40


def test_longer_phrases_and_an_empty_table(spark, awkward, rows, nothing):
    assert collocations.collocations(nothing).count() == 0
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(awkward, max_words=4, least=3, top=50).collect())
    assert got == phrases_of([(r[2], r[1]) for r in rows], max_words=4, least=3, top=50)


def test_words_of_one_code_are_told_apart(spark, monkeypatch):
    plain = collocations.xxh3_64_intdigest
    # At the first seed all words share three codes.
    clash = lambda raw, seed=0: plain(raw, seed) % 3 + 1 if seed == 0 and isinstance(raw, bytes) else plain(raw, seed)
    monkeypatch.setattr(collocations, "xxh3_64_intdigest", clash)
    rows = [("en", "a b c d e f. " * 12)]
    got = [tuple(r[c] for c in COLUMNS) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()]
    assert sorted(got) == phrases_of(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 2**40 + 1, 2**41 + 3, 2**42 + 5
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s == 10**6 * a * a // (left * right)


# --- fill-in-middle

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(key, text):
    text = text or ""
    h = [int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    tokens = TOKENS.findall(text)
    n = len(tokens)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_of_awkward_rows(spark, rows, nothing):
    draw = random.Random(9)
    signs = ["a", " ", "\n", "\t", "é", "\U0001f600", "<", "P>", "<S", "\x1f", "\xa0", "<M>"]
    mine = [(r[0], r[1]) for r in rows] + [(1000 + i, "".join(draw.choice(signs) for _ in range(draw.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(mine, "doc_id bigint, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = infill.fill_in_middle(df).collect()
    have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode()) for r in got), key=repr)
    assert have == sorted((filled(*m) for m in mine), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.restored.decode() for r in got) == sorted(t or "" for _, t in mine)
    assert infill.fill_in_middle(nothing).count() == 0
    again = infill.fill_in_middle(df.repartition(1), remembered=50).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


@pytest.mark.parametrize("digest", [None, lambda chunk: len(chunk) % 3])
def test_cuts_by_chunks_are_those_of_the_text(monkeypatch, digest):
    """Also when chunks are tiny, memory is full and different chunks share a hash."""
    draw = random.Random(1)
    signs = ["a", "b", " ", "\n", "é", "\U0001f600", "\t", "\x1f", "\xa0"]
    for _ in range(60):
        monkeypatch.setattr(infill, "LONGEST", draw.choice([5, 9, 4096]))
        monkeypatch.setattr(infill, "CHUNK_BITS", draw.choice([1, 3, 8]))
        memory = infill.ChunkMemory(draw.choice([10, 10_000]), *([digest] if digest else []))
        texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 200))) for _ in range(6)]
        raws = [t.encode() for t in texts]
        for text, raw, ends in zip(texts, raws, infill.chunk_places(raws)):
            outline, tokens = infill.Outline(raw, ends, memory), TOKENS.findall(text)
            assert outline.tokens == len(tokens)
            for k in range(len(tokens) + 1):
                before = "".join(tokens[:k])
                assert outline.cut(k) == (len(before.encode()), len(before))


def test_shared_passages_are_summarized_once():
    draw = random.Random(2)
    passage = " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(2000)).encode()
    memory = infill.ChunkMemory()
    texts = [b"one head " + passage, b"another, longer head " + passage]
    for raw, ends in zip(texts, infill.chunk_places(texts)):
        infill.Outline(raw, ends, memory)
    assert memory.reused > 0.9 * memory.made


# --- samples of labelled rows


def test_no_share_is_too_small_to_draw(spark):
    rows = 4_000_000
    share = 4_000 / 10**11
    assert int(share * 1_000_000) == 0
    # As many rows as a table of 10^11 would give for this share, in a table of 4 million that stands for a part of it.
    many = spark.range(rows).where(drawn(200 / rows, "id")).count()
    assert 140 < many < 260
    bound = math.floor(share * (1 << 53))
    assert bound > 0 and spark.range(1).select(F.lit(share * (1 << 53)) > 0).first()[0]


def test_a_key_repeated_many_times_is_one_row_of_a_fit(spark, monkeypatch):
    drawn_rows = []
    plain = langid._train
    monkeypatch.setattr(langid, "_train", lambda x, *a: (drawn_rows.append(len(x)), plain(x, *a))[1])
    texts = {"en": "the quick brown fox", "fr": "le renard brun et la maison"}
    few = [(i, f"{texts[lang]} {i}", lang) for i in range(40) for lang in [list(texts)[i % 2]]]
    df = spark.createDataFrame(few, "doc_id bigint, text string, lang string")
    hot = spark.range(50_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(few[7][1]).alias("text"), F.lit("fr").alias("lang"))
    assert langid.fit_language(df.unionByName(hot), max_rows=100_000) is not None
    assert drawn_rows[0] <= 40


def test_repeated_rows_and_strange_labels_of_the_lexicon(spark):
    rows = [(i, "you vile wretch, begone" if i % 2 else "a calm and pleasant day") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hot = spark.range(20_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit(rows[3][1]).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 7), (1, -1), (2, None)], "doc_id bigint, toxic int")
    once, often = toxicity.fit_lexicon(df, labels), toxicity.fit_lexicon(df.unionByName(hot), labels)
    assert once.weights == often.weights and once.weights
