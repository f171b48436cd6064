"""Each stage of the corpus pipeline against a plain version, on a table with nulls, repeated keys and copies."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from seqmine.llm import tokens

WORDS = ["river", "stone", "light", "under", "green", "house", "early", "water", "north", "table", "paper", "cloud", "field", "seven", "music"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    texts = {k: prose(rng, rng.randint(30, 120)) for k in range(40)}
    for k in range(40, 60):  # copies and near copies, one word changed
        words = texts[k % 12].split()
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        texts[k] = " ".join(words)
    out = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in texts.items()]
    out += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "too few words", "en", "s0", 13), (103, "again and " * 90, "en", "s1", 900),
            (104, "!!! # # # $ $ " * 40, "en", "s1", 560), (105, prose(rng, 9000), "en", "s2", 1)]
    other = prose(rng, 60)
    # One key with two texts, one of them known; rows without a key, one of them a copy and one twice.
    out += [(200, other, "en", "s2", 1), (200, texts[3], "en", "s2", 1), (None, texts[5], "en", "s0", 1), (None, prose(rng, 50), "en", "s0", 1)]
    out += [out[-1], (201, prose(rng, 40), "en", None, 1), (201, prose(rng, 40), "fr", None, 1)]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    rng = random.Random(2)
    labels = [(k, int(k % 5 > 0), int(rng.random() < 0.05)) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_distinct_against_all_pairs(spark, rows):
    found = plain(corpus_pipeline.distinct(spark, spark.createDataFrame(rows, SCHEMA), ""))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    assert sum(found.values()) == len(groups) < len(rows) - 15
    shared = Counter(r[0] for r in rows)
    for members in groups.values():
        own = [r for r in members if r[0] is not None and shared[r[0]] == 1]
        kept = [r for r in set(members) if found[r]]
        assert kept and (not own or min(own) in kept)


def test_clean_against_plain_rules(spark, rows):
    kept = plain(corpus_pipeline.clean(spark, spark.createDataFrame(rows, SCHEMA), ""))
    for r in rows:
        text = r[1] or ""
        words = text.split()
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
        chars = sum(map(len, words))
        bad = (len(words) < 20 or 100 * len(covered) > 30 * len(words) or sum(text.count(c) for c in "#*$%&|<>") * 20 > chars
               or text.count("!") * 20 > chars or sum(c.isascii() and c.isupper() for c in text) * 3 > chars)
        assert bool(kept[r]) != bad


def test_packed_holds_every_id_once(spark, rows):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokens.default_tokenizer())
    ids = lambda r: len(encoder.encode(r[1] or "", add_special_tokens=False).ids) + 1
    found = corpus_pipeline.packed(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sum(p.length for p in found) == sum(map(ids, rows))
    single = [r for r in rows if Counter(x[0] for x in rows)[r[0]] == 1]
    for r in single:
        pieces = sorted((p.start, p.length, p.doc_tokens) for p in found if p.doc_id == r[0])
        assert [s for s, _, _ in pieces] == np.cumsum([0] + [n for _, n, _ in pieces])[:-1].tolist()
        assert sum(n for _, n, _ in pieces) == ids(r) == pieces[0][2]
    sequences = {}
    for p in found:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist() and pieces[-1][0] + pieces[-1][1] <= 2048


def test_run_chains_the_stages(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = plain(docs)
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), SCHEMA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and not plain(docs) - before
    want = corpus_pipeline.packed(spark, docs, sf_dir)
    got = corpus_pipeline.run(spark, sf_dir)
    whole = lambda df: sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in df.where("doc_tokens <= 2048").collect())
    assert whole(got) and sum(r.length for r in got.collect()) == sum(r.length for r in want.collect())


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
