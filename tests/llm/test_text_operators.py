"""Operators on text against plain simulations on small hand-made tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from seqmine.llm import (bpe, html_text, minhash, packing, quality_model, quality_rules, token_files, tokens, url_rules, vector_dups,
                         warc)

TEXTS = [None, "", "  two  spaces\n\n and lines ", "plain words in a row", "plain words in a row", "x<|endoftext|> y", "日本語のテキスト 🙂 é",
         "a\u00a0b \x1c c\r\nd", "unsplit" * 700, "12345" * 600, "word " * 900, "'s't're " * 200, " " * 500 + "end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "meta", 1) for k, t in enumerate(TEXTS)] + [(None, "no key", None, None), (8, TEXTS[8], "again", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, start int")  # names that results use


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def empty(df):
    return df.limit(0)


def test_units_equal_the_library(library):
    rng = random.Random(3)
    parts = ["a", "word", " ", "\n", "\t", "'s", "1", "é", "\u00a0", "<|endoftext|>", "\x85", "🙂", "語"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    enc = tokens.Encoder(tokens.default_tokenizer())
    assert enc.encode(texts) == enc.whole(texts)


@pytest.mark.parametrize("cut", [1, 3, 50, 333])
def test_joins_equal_the_library(library, cut):
    enc = tokens.Encoder(tokens.default_tokenizer())
    rng = random.Random(cut)
    for text in [t for t in TEXTS if t] + ["".join(rng.choices("abcdefgh", k=900)), "語学" * 200, "don't" * 90]:
        parts = [(text[a:a + cut], np.frombuffer(enc.whole([text[a:a + cut]])[0], "<u4")) for a in range(0, len(text), cut)]
        assert bpe.join_all(enc, parts).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode(docs, library):
    found = bpe.decode(bpe.encode(docs, leaf=100)).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want
    assert all(r.text == library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in found)
    assert bpe.encode(empty(docs)).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1001, dtype=np.uint32)
    assert (token_files.from_planes(token_files.to_planes(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(docs, library, kind):
    found = token_files.write_and_read(docs, planes=kind, block=64).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, *range(9), 8, *range(9, len(TEXTS))]
    at, text = 0, dict(enumerate(TEXTS)) | {None: "no key"}
    for r in found:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    assert token_files.write_and_read(empty(docs)).count() == 0


def test_packing(docs, library):
    rows = packing.pack(docs, window=64, group_tokens=1000).collect()
    sequences, pieces = defaultdict(list), defaultdict(dict)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].setdefault(r.start, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 64
    for k, t in [*enumerate(TEXTS), (None, "no key")]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        copies = 2 if k == 8 else 1
        assert sum(r.length for same in pieces[k].values() for r in same) == copies * len(ids)
        for start, same in pieces[k].items():
            assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[start:start + r.length] for r in same)
    assert packing.pack(empty(docs)).count() == 0


def test_best_fit_takes_the_tightest_room():
    tree = packing.RoomTree(64)
    rng, rooms = random.Random(2), []
    for k in range(500):
        if rng.random() < 0.6:
            rooms.append((rng.randint(1, 64), k))
            tree.put(k, rooms[-1][0])
        else:
            need = rng.randint(1, 64)
            fit = [r for r, _ in rooms if r >= need]
            found = tree.take(need)
            assert (found and found[1]) == (min(fit) if fit else None)
            if found:
                rooms.remove((found[1], found[0]))


def simulated_rules(text):
    words = (text or "").encode().split()
    w = [x.decode() for x in words]
    starts = defaultdict(list)
    for i in range(len(w) - 7):
        starts[tuple(w[i:i + 8])].append(i)
    covered = {i + k for places in starts.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = [*TEXTS, "one two three four five six seven eight nine ten " * 3, "# " * 40, "LOUD TEXT " * 30 + "x", "a\na\n \nb\na\n" * 9,
             " ".join(f"w{k % 31}" for k in range(80))]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality_rules.judge(df).collect():
        want = simulated_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (r.kept is False or not r.base_failed)
    assert quality_rules.judge(empty(df)).count() == 0
    assert quality_rules.judge(df).where("kept").count() == sum(r.kept for r in quality_rules.judge(df).collect())


def smallest(nodes, links):
    up = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = [None, "", "only three words", "ONLY three words", *[" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(6)]]
    for base in texts[4:8]:
        for n in (0, 1, 2, 6):
            words = base.split()
            for _ in range(n):
                words[rng.randrange(60)] = "x"
            texts.append(" ".join(words))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[4])], "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS k")

    def shingles(t):
        w = (t or "").lower().split()
        n = min(4, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = smallest(range(len(sets)), links)
    found = minhash.near_duplicates(df, words=4).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), up[r.doc_id], up[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty(df)).count() == 0


def test_near_duplicates_among_sets_that_share_a_passage(spark):
    rng = random.Random(9)
    word = lambda n: [str(rng.getrandbits(40)) for _ in range(n)]
    passage, rows = word(123), []
    for k in range(300):  # 0.75 alike: they share most buckets and are not linked
        rows.append((k, " ".join(passage + word(20))))
    for k in range(40):  # 0.806 alike, few in a bucket of their own
        rows.append((1000 + k, " ".join(rows[k][1].split()[:128] + word(15))))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(k, k - 1000 if k >= 1000 else k) for k, _ in rows}


def test_vector_duplicates(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 8))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(np.repeat(base, 5, 0) + rng.standard_normal((150, 8)) * 0.15)]
    rows += [(150, rows[0][1], 0), (151, None, 0), (152, [0.0] * 8, 0), (153, [float("nan")] * 8, 1), (154, [None] * 8, 1), (155, rows[0][1], None),
             (156, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS n_links")
    fit = {k: (np.array(v) / np.linalg.norm(v), lab) for k, v, lab in rows
           if k is not None and v is not None and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in fit for b in fit if a < b and fit[a][1] == fit[b][1] and len(fit[a][0]) == len(fit[b][0]) and fit[a][0] @ fit[b][0] >= 0.93]
    up = smallest([r[0] for r in rows if r[0] is not None], links)
    found = vector_dups.near_duplicates(df, window=16, block=32, square=4).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == (sum(r.vec_id in pair for pair in links), up[r.vec_id]), r
    assert vector_dups.near_duplicates(empty(df)).count() == 0


def test_vector_duplicates_in_a_dense_cloud(spark):
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    common, noise = unit(rng.standard_normal(64)), unit(rng.standard_normal((1500, 64)))
    noise[1400:] = unit(noise[:100] + 0.7 * unit(rng.standard_normal((100, 64))))
    for share in (0.42, 1.0):  # mean cosine 0.85 and 0.5
        x = unit(common + share * noise)
        near = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
        up = smallest(range(len(x)), [(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near))) if a < b])
        df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        found = vector_dups.near_duplicates(df, window=16, block=128, square=256).collect()
        assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(k, int(near[k].sum()), up[k]) for k in up}


def test_archives(spark):
    long = "<p>" + "long text " * 200
    rows = [(1, "http://a/é x", long, 1), (2, None, long, 2), (3, "http://b", "short", 3), (4, "http://b", "short", 4), (5, "u", None, 5), (None, "v", long, 6),
            (2, None, long, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int").repartition(2)
    folder_rows = warc.write_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for k, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and k is not None and k < 2
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert sorted(map(str, map(tuple, folder_rows))) == sorted(map(str, want))
    assert warc.write_and_read(empty(df)).count() == 0


def test_archive_splits_and_false_magic(spark, tmp_path):
    from seqmine.llm.storage import AttemptFile

    out = AttemptFile(str(tmp_path), 0, ".warc.gz")
    bodies = [b"\x1f\x8b\x08" * k + random.Random(k).randbytes(200) for k in range(20)]
    for k, body in enumerate(bodies):
        out.write(warc.page_record(k, "u", body, hashlib.sha1(body).hexdigest(), None, "2024-01-01T00:00:00Z", 0))
    out.close()
    files = spark.createDataFrame([(out.path, out.size)], "path string, bytes long")
    for split in (7, 100, 1 << 20):
        found = warc.read(files, split).collect()
        assert sorted((r.record_id, bytes(r.payload)) for r in found) == sorted((f"<urn:x-page:{k}>", b) for k, b in enumerate(bodies))


def test_damaged_archives(spark, tmp_path):
    bodies = [random.Random(k).randbytes(300) for k in range(12)]
    parts = [warc.page_record(k, "u", body, hashlib.sha1(body).hexdigest(), None, "2024-01-01T00:00:00Z", 6) for k, body in enumerate(bodies)]
    flipped = bytearray(parts[3])
    flipped[len(flipped) // 2] ^= 1
    whole = b"".join(parts)
    files, want = {"whole": whole, "empty": b"", "foreign": b"no archive at all"}, {"whole": [], "empty": [], "foreign": [(0, 17)]}
    files["padded"] = whole + b"\0" * 16
    want["padded"] = [(len(whole), len(whole) + 16)]
    at = sum(map(len, parts[:3]))
    cut = parts[9][:-5]
    files["hit"] = b"".join([*parts[:3], flipped, *parts[4:9], cut, parts[10], b"\0\0", parts[11]])
    after = at + len(parts[3]) + sum(map(len, parts[4:9]))
    want["hit"] = [(at, at + len(parts[3])), (after, after + len(cut)), (after + len(cut) + len(parts[10]), after + len(cut) + len(parts[10]) + 2)]
    kept = {"whole": range(12), "padded": range(12), "hit": [0, 1, 2, 4, 5, 6, 7, 8, 10, 11], "empty": [], "foreign": []}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([(str(tmp_path / n), len(data)) for n, data in files.items()], "path string, bytes long")
    for split in (90, 1 << 20):
        found = {n: [] for n in files}
        for r in warc.read(df, split).collect():
            found[r.path.rsplit("/", 1)[1]].append((r.record_id, bytes(r.payload)))
        assert {n: sorted(v) for n, v in found.items()} == {n: sorted((f"<urn:x-page:{k}>", bodies[k]) for k in ks) for n, ks in kept.items()}
        holes = {n: [] for n in files}
        for r in warc.damaged(df, split).collect():
            holes[r.path.rsplit("/", 1)[1]].append((r.start, r.end))
        assert {n: sorted(v) for n, v in holes.items()} == want


def test_main_text(spark):
    page = ("<html><body><nav><a href=x>menu</a></nav><div class='ad'>advert</div><div class='post-{0}'><h1>Title&nbsp;{0}</h1><p>First <b>bold</b> text, "
            "&amp; more of it.<p>Second<br>block<script>var a='</p>';</script></div><div class=comments><p>A reader says much</div>"
            "<form>mail</form><footer>end</footer></body></html>")
    rows = [(k, f"http://h/{k}", page.format(k)) for k in range(4)] + [(5, None, None), (6, "http://h/e", ""), (7, None, "bare &lt;text&gt;"), (8, "x", "<p>open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS path")
    found = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert found == {**{k: f"Title {k} First bold text, & more of it. Second block" for k in range(4)}, 5: "", 6: "", 7: "bare <text>", 8: "open"}
    assert html_text.extract(empty(df)).count() == 0


PAGES = [  # html, its main text
    ("<article><h1>Title of it</h1><p>Lead text here</p><div class=body>" + "long text " * 40 + "</div></article>", "Title of it Lead text here " + "long text " * 40),
    ("<div class='content-sidebar-wrap'><main><article>main text words and more</article></main><div class=x>other</div></div>", "main text words and more"),
    ("<body class=no-header><div class='has-sidebar'><div class=entry><p>one two</p></div><div class=sidebar>bad</div></div>", "one two"),
    ("<div class='sidebar-left'><p>alpha beta</p><p>gamma delta</p></div><div class=y>end</div>", "alpha beta gamma delta"),
    ("<article><p>one</p><object data=x><p>two three four five</p></article>", "one two three four five"),
    ("<article><p>one</p><select><option>q<p>two three</p></article>", "one q two three"),
    ("<article><p>one</p><select><option>q</select><noscript>no</noscript><svg><text>no</text></svg><p>two</p></article>", "one two"),
    ("<p>" + "\u0130" * 12 + "<script>x</script>abcdefghi</p>", "\u0130" * 12 + "abcdefghi"),
    ("<title>a</titlefoo>b</title><p>c</p>", "c"),
    ("<div class=post><p>text one</p><p>text two</p></div><div id=comments><article class=comment>" + "long talk " * 30 + "</article></div>", "text one text two"),
    ("<div class='ad'>" + "advert " * 50 + "</div><div class=post>short</div>", "short"),
    ("<article class='has-comments'><section class=a><p>one</p></section><section class=b><p>two</p></section></article>", "one two"),
    ("<div>" * 5000 + "deep", "deep"), ("<p>" + "word " * 200_000, "word " * 200_000), ("<article><a href=x>only a link</a></article>", "only a link"),
]


def test_main_text_of_layouts():
    for html, text in PAGES:
        assert html_text.extract_page(html, None) == text.strip(), html[:200]


def test_main_text_by_hosts(spark):
    story = "<body><div class=story><h1>T{0}</h1><p>Story text of page {0}</p></div><div class=x><p>{1}</p></div>"
    list_ = "<body><div class=log><p>Entry {0} of a log</p></div><div class=x><p>{1}</p></div>"
    rows = [(k, f"http://Two/{k}", (story if k % 3 else list_).format(k, "more" if k else "a box that is longer than the log of this page " * 9)) for k in range(12)]
    rows += [(k, f"http://two/{k}", rows[k][2]) for k in (1, 3)] + [(None, "http://two/n", rows[1][2]), (50, None, rows[1][2]), (60, "http://tie/1", "<body><div class=a><p>x</p></div><div class=b><p>y</p></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r.host: r.paths for r in html_text.host_paths(df).collect()}
    assert paths == {"two": ["/body/div.log", "/body/div.story"], "tie": ["/body/div.a"]}
    found = sorted((-1 if r.page_id is None else r.page_id, r.text) for r in html_text.extract(df).collect())
    want = lambda k: f"T{k} Story text of page {k}" if k % 3 else f"Entry {k} of a log"
    assert found == sorted([(k, want(k)) for k in [*range(12), 1, 3]] + [(-1, want(1)), (50, want(1)), (60, "x")])


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/en/12?x", "ftp://example.org/es/", "http://x.com/fr/1", "https://com/de/", "http://x.com/fr", "a://b://c/d",
            "http://notexample.org/es/", "http://x.org"]
    good = [(f"http://fine{k % 7}.net/page/{k}", False) for k in range(60)]
    bad = [(f"http://win{k % 5}.spam.net/page/{k}", True) for k in range(40)]
    labelled = spark.createDataFrame([*good, *bad, (None, True), ("http://u.net", None)], "url string, bad boolean")
    rules = url_rules.mine(labelled)
    assert [r.wanted for r in rules.collect()] == [["h:spam"]] or {tuple(r.wanted) for r in rules.collect()} >= {("h:spam",)}
    rows = [*enumerate(urls), (20, "http://new.spam.net/page/7"), (21, "http://fine9.net/page/7"), (None, "http://spam.org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, rules).collect()}
    assert found[3] == ("a.example.org", "/en/12", "example.org/en/1", "block") and found[4][2:] == ("example.org/es/", "block")
    assert found[5][2:] == ("com/fr/", "allow") and found[6][2:] == ("com/de/", "block") and found[7][2] is None
    assert found[8][:2] == ("b:", "//c/d") and found[9][2:] == ("org/", "allow") and found[10] == ("x.org", "", None, "allow")
    assert all(found[k] == ("", "", None, "allow") for k in range(3))
    assert found[20][3] == "block" and found[21][3] == "allow" and found[None][2] == "org/"
    assert url_rules.judge(empty(df), url_rules.mine(empty(labelled))).count() == 0


def test_url_rules_need_a_count_not_a_share(spark):
    good = spark.range(20_000).selectExpr("concat('http://fine', id % 9, '.net/a/', id) AS url", "false AS bad")
    bad = spark.range(25).selectExpr("concat('http://rare.net/b/', id) AS url", "id < 22 AS bad")
    few = spark.range(9).selectExpr("concat('http://few.net/a/', id) AS url", "true AS bad")
    rules = url_rules.mine(good.union(bad).union(few)).collect()
    assert {(tuple(r.wanted), round(r.confidence, 2)) for r in rules} == {(("h:rare",), 0.88), (("p:b",), 0.88)}


def test_classifier_without_labels(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "text", 4)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    found = quality_model.classify(df, none).collect()
    assert len(found) == 2 and all(r.kept and r.quality_score is None for r in found)


def test_classifier_on_unseen_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_model.classify(docs, labels.where("doc_id % 3 > 0")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    right = found.where("kept = (quality = 1)").count()
    assert right >= 0.95 * found.count()
