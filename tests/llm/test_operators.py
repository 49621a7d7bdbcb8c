"""Each operator against brute force, on small tables with the awkward rows that real ones have."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetlint.llm import byte_bpe, dom, exact_dedup, fingerprints, html_text, near_dedup, packing, secrets, suffix_dedup, token_files, tokens, toxicity

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(3000)]
SCHEMA = "doc_id long, text string, score string, kept string, component string, n long"


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def edited(text, seed, n):
    words = text.split(" ")
    for i in random.Random(seed).sample(range(len(words)), n):
        words[i] = f"x{seed}_{i}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    rows = [(1, base), (2, base), (3, base.replace(" ", "\n ", 3)), (4, edited(base, 4, 2)), (5, edited(base, 5, 6)),
            (6, edited(base, 6, 12)), (7, None), (8, ""), (9, "one two"), (10, "One TWO"), (11, prose(2, 9000)), (12, "é" * 900),
            (13, prose(3, 40) + " " + base), (13, prose(3, 40) + " " + base), (14, "a" * 900), (None, "no id"), (15, " \t ")]
    return rows + [(100 + i, edited(base, 100 + i, 3 + i % 9)) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns that operators use inside are there under the same names."""
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty, texts):
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    for heavy in (1, 1024):
        got = exact_dedup.duplicate_groups(docs, heavy=heavy).collect()
        assert len(got) == len(texts)
        want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]),
                       hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.duplicate_groups(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def shingles(text, n):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute_components(texts, n):
    sets = {}
    for i, t in texts:
        if i is not None:
            sets[i] = shingles(t, n)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if label[a] < label[b] and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_dedup(docs, texts, n, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", 0)  # blocks must find what one pivot does not
    want = brute_components(texts, n)
    got = near_dedup.groups(docs, words=n).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_dedup_rows(docs, empty):
    assert near_dedup.deduplicate(docs).columns == docs.columns
    assert near_dedup.groups(empty).count() == 0


def test_set_sketch():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    k = near_dedup.sketches([a, b, np.union1d(a, b)])
    assert (near_dedup.merge(k[0], k[1]) == k[2]).all()
    found = near_dedup.joint_estimate(k[:1], k[1:2], np.array([1000.0]), np.array([1000.0]))
    assert abs(found[0] - 900 / 1100) < 0.12


@pytest.mark.parametrize(("keep_first", "hot"), [(False, 20_000), (False, 1), (True, 20_000), (True, 1)])
def test_suffix_dedup(docs, texts, keep_first, hot):
    length = 100
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    first, want = set(), []
    for i, b in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            window = b[k:k + length]
            if seen[window] > 1 and (not keep_first or window in first):
                gone[k:k + length] = b"\1" * length
            first.add(window)
        want.append((str(i), len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = suffix_dedup.without_repeats(docs, length, keep_first, hot=hot).collect()
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got]
    if keep_first:  # rows that repeat an id and a text share their cuts
        got, want = ([r for r in x if r[0] != "13"] for x in (got, want))
    assert sorted(got) == sorted(want)


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.without_repeats(empty, 100).count() == 0


def test_fingerprints(docs, empty, texts):
    rows = fingerprints.fingerprints(docs).collect()
    by_text = {}
    for i, t in texts:
        by_text.setdefault(t or "", set()).update(r.fingerprint for r in rows if r.doc_id == i)
    assert len(by_text[texts[0][1]]) == 1 and by_text[""] == {"-"}
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted({i: t or "" for i, t in texts}.items(), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    for k, (i, t) in enumerate(order):
        third, after = len(t) // 3, order[(k + 1) % len(order)][1]
        if i != 13:  # its row is there twice, so it is its own next document
            assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - third] + after[:third]).encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_next_documents_cross_buckets(spark):
    rows = spark.createDataFrame([(i, str(i), str(i)) for i in range(0, 400, 3)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(rows, rows_per_bucket=10).collect()}
    ids = list(range(0, 400, 3))
    assert got == {i: str(ids[k - 1]) for k, i in enumerate(ids)}


KEY = "AK" + "IA" + "ABCDEFGHIJKLMNOP"


def test_secrets(spark, empty):
    rows = [(1, "é pass" + "word = 'abcdef123456+/' and " + KEY), (2, "to" + "ken: short1"), (3, "user=bob\npwd: hunter22\nhost=db.example.org"),
            (4, None), (5, "pass" + "word: sec" + "ret: abcdefghijklmnop"), (6, "0123456789abcdef" * 2), (7, "user=bob alone"),
            (8, "user=bob " + "z " * 400 + "pwd: hunter22"), (3, "user=bob\npwd: hunter22\nhost=db.example.org")]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in rows], "doc_id long, text string, spans string, linked string")
    got = {r.doc_id: r.s for r in secrets.find(docs).select("doc_id", secrets.as_text("spans").alias("s")).collect()}
    assert got[1].split(",") == [f"assign:2:{rows[0][1].index('/') + 1}", f"access:{rows[0][1].index('AK')}:{len(rows[0][1])}"]
    assert got[2] == got[4] == got[5] == got[7] == got[8] == "" and got[6] == "hex:0:32"
    assert [s.split(":")[0] for s in got[3].split(",")] == ["ident", "weak", "endpoint"]
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert {r.doc_id: r.text for r in masked.collect()}[6] == "[SECRET]"
    assert secrets.find(empty).count() == secrets.redact(empty).count() == 0


def test_scope_is_the_gap_between_parts(spark):
    long = "to" + "ken=" + "aB3." * 250
    rows = [(1, long + "\nuser=bob\nhost=db.example.org"), (2, "user=bob\nhost=db.example.org\n" + long), (3, "https://x.org/" + "a/" * 500 + " user=bob pwd: hunter22"),
            (4, long + " " * 301 + "user=bob"), (5, "user=bob" + " " * 301 + long), (6, long + " " * 300 + "user=bob")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.split(":")[0] for s in r.s.split(",")] for r in secrets.find(docs).select("doc_id", secrets.as_text("spans").alias("s")).collect()}
    assert got[1] == ["assign", "ident", "endpoint"] and got[2] == ["ident", "endpoint", "assign"] and got[3] == ["endpoint", "ident", "weak"]
    assert got[4] == got[5] == ["assign"] and got[6] == ["assign", "ident"]
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()}[1] == "[SECRET]\n[SECRET]\n[SECRET]"


def library_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["a  b", " a", "a ", "\n\nx", "x \n y", "don't  stop", "a\tb", " x", "<|endoftext|> b", "z" * 3000, "日本語 テスト", "a\n", "\r\n x", "é", ""]


def test_stretches_equal_the_library():
    encoder, size = tokens.library_encoder(packing.TOKENIZER)
    assert size == 50257
    small = tokens.StretchCache(encoder.encode_strings, entries=4)
    for cache in (encoder, small):
        assert [np.frombuffer(b, "<u4").tolist() for b in cache.encode_texts(ODD)] == [library_ids(t) for t in ODD]


def test_stretches_with_nul_equal_the_library():
    encoder, _ = tokens.library_encoder(packing.TOKENIZER)
    nul = ["b c", "a \0b", "\0b", " \0b", "a\n\0b", "\0", "a \0", "b"]
    for cache in (tokens.StretchCache(encoder.encode_strings), tokens.StretchCache(encoder.encode_strings, entries=4)):
        assert [np.frombuffer(b, "<u4").tolist() for b in cache.encode_texts(nul)] == [library_ids(t) for t in nul]


def test_byte_bpe_equals_the_library(docs, empty, texts):
    import tiktoken

    bpe, cache = byte_bpe.load(byte_bpe.RANKS)
    encoding = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(3)
    noise = ["".join(rng.choices("abcdeéß '0z\n", k=60)) for _ in range(60)]
    for text in ODD[:9] + ODD[10:] + noise + ["z" * 300]:
        ids = np.frombuffer(cache.encode_texts([text])[0], "<u4").tolist()
        assert ids == encoding.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    got = byte_bpe.encoded(docs).collect()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(encoding.encode_ordinary(t or "")) for _, t in texts)
    assert byte_bpe.encoded(empty).count() == 0


def test_packing(docs, empty, texts):
    tokens_, documents, cost = 300, 4, 60_000.0
    got = packing.pack_documents(docs, tokens=tokens_, documents=documents, cost=float(tokens_) ** 2).toPandas()
    assert got["length"].sum() == sum(len(library_ids(t)) + 1 for _, t in texts)
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence["offset"]) == [0, *np.cumsum(sequence["length"])[:-1]]
        assert sequence["length"].sum() <= tokens_ and len(sequence) <= documents
    assert (got[got.piece > 0].length == tokens_).all()
    ids = library_ids(texts[0][1]) + [0]
    row = got[got.doc_id == 1].iloc[0]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4")[int(row.start):int(row.start + row.length)].tobytes())
    lengths = np.random.default_rng(1).integers(1, 200, 2000)
    for score in ("residual", "dot"):
        place = packing.best_fit(lengths, tokens_, documents, cost, score=score)
        assert np.bincount(place, lengths).max() <= tokens_ and np.bincount(place).max() <= documents
        assert np.bincount(place, lengths.astype(float) ** 2).max() <= cost
    assert packing.best_fit(lengths, 2048, 2048, 2048.0**2).max() + 1 <= lengths.sum() / 2048 + 2
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), bits, len(ids)) == ids).all()
    assert len(token_files.pack_bits(ids, bits)) == -(-1003 * bits // 8)


def test_token_files(spark, docs, empty, texts, tmp_path):
    files = token_files.write_tokens(docs, f"file://{tmp_path}/ids", files=3)
    got = token_files.read_tokens(spark, files, split_docs=5).toPandas().sort_values(["start"])
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    ids = [library_ids(t) + [0] for _, t in order]
    assert [None if i != i else int(i) for i in got.doc_id] == [i for i, _ in order]
    assert list(got.n_tokens) == list(map(len, ids)) and list(got.start) == [0, *np.cumsum(list(map(len, ids)))[:-1]]
    assert list(got.ids_crc32) == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert token_files.bits_for(50257) == 16
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, f"file://{tmp_path}/none")).count() == 0


def page(k, host="h"):
    return (f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='top'>Same words on every page</div><div id=x><h1>T{k}</h1>"
            f"<p>Text &amp; more {k}\n of it<br>goes on<p>Second {k} <b>bold</b><div class=comments><p>Reader {k}</div>"
            f"<p>Follow us now</div><footer>&copy; {k}</footer><script>var t='<p>';</script></body></html>")


def test_html_text(spark):
    rows = [(k, f"https://h.example/{k}", page(k)) for k in range(8)] + [
        (20, None, None), (21, "bad url", ""), (22, "https://h.example/cut", page(22)[:260]), (23, "https://lone.example/", page(23)), (0, "https://h.example/0", page(0))]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(
        [(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[3] == "T3\nText & more 3 of it goes on\nSecond 3 bold"  # constant blocks, comments and menus are gone
    assert got[20] == got[21] == "" and got[22].startswith("T22\nText & more 22")
    assert got[23].startswith("Same words on every page\nT23") or got[23].startswith("T23")
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_texts(nothing).count() == 0


def test_tree_matching():
    a, b = dom.parse("<div><p>1</p><p>2</p><ul><li>3</ul></div>"), dom.parse("<div><p>1</p><h2>x</h2><ul><li>3<li>4</ul></div>")
    assert dom.match(html_text.new_template(a), b) == 5 and dom.text_of(b) == "1 x 3 4"


def test_attribute_names_are_read_exactly():
    kept = ("<a href='/hidden-valley'>one</a> <p title='a hidden story'>two</p><div data-role=dialog>three</div><div data-id='menu'>four</div>"
            "<p data-x=hidden>five<p title='class=\"promo\"'>six</p>")
    assert html_text.main_text(kept).split() == ["one", "two", "three", "four", "five", "six"]
    assert html_text.main_text("<p>a<p HIDDEN>b<p class = 'x promo'>c<div role=dialog>d</div><p id=menu>e<p style='display: none'>f") == "a"


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "<span>" * 5000 + "words"
    a, b = dom.parse(deep), dom.parse(deep + " more")
    assert dom.match(html_text.new_template(a), b, []) == 5001 and dom.text_of(b) == "words more"
    pages = spark.createDataFrame([(k, "https://deep.example/", deep + str(k)) for k in range(4)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_texts(pages).collect()} == {k: f"words{k}" for k in range(4)}


def test_blocks_and_layouts_that_the_sample_misses(spark):
    def source(k):
        notice = "<div class=x7>We move house in May</div>" if k % 10 == 0 else ""
        if k % 20 == 5:
            return f"<html><body class=b><section><div class=y>Our other layout says this</div><div class=z><p>Other {k}<p>More {k}</div></section></body></html>"
        return f"<html><body><div class=c><h1>T{k}</h1>{notice}<p>Text {k}</p><p>Second {k}</p></div></body></html>"

    rows = [(k, f"https://big.example/{k}", source(k)) for k in range(200)]
    pages = spark.createDataFrame(rows + rows[:50], "page_id long, url string, html string")
    for sample in (1, html_text.SAMPLE):
        got = {r.page_id: r.text for r in html_text.main_texts(pages, sample=sample).collect()}
        assert got == {k: f"Other {k}\nMore {k}" if k % 20 == 5 else f"T{k}\nText {k}\nSecond {k}" for k in range(200)}


def test_toxicity(spark, empty):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        bad = i % 6 == 0
        words = rng.choices(WORDS[:400], k=60)
        if bad:
            words[7], words[33] = rng.choice(["grobian", "lump"]), rng.choice(["grobian", "lump"])
        rows.append((i, " ".join(words), "s"))
        if i % 5 < 3:  # whether a document is labelled says nothing of its kind
            labels.append((i, int(bad)))
    rows += [(700, None, "s"), (701, "", "s"), (None, "grobian lump", "s"), (702, "grobian " * 5000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (0, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, marks).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600))
    assert all(got[i].predicted == int(i % 6 == 0) for i in range(600)) and got[700].score == got[701].score < 0.7
    assert got[None].predicted == got[702].predicted == 1
    left = toxicity.without_toxic(docs, marks)
    assert left.columns == docs.columns and left.count() == 502
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scored(docs, none).collect()} == {0} and toxicity.scored(empty, none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "near dedup":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items()), 5).items() if c == i}
        if name == "exact dedup":
            assert len({" ".join(t.split()) for t in before.values()}) >= len(after)
        assert set(after) <= set(before) and len(after) > 0.7 * len(before)
    assert corpus_pipeline.run(spark, SF).where("offset + length > 2048").count() == 0


def test_stretches_encoded_as_one_text_have_their_own_ids():
    calls = []
    encoder, _ = tokens.library_encoder(packing.TOKENIZER)

    def encode(strings):
        calls.append(len(strings))
        return encoder.encode_strings(strings)

    strings = [" a", "\nb", " ", "\n", " don't", " ümläut", " 漢字🙂", " x9,'s", " <|endoftext|>", "\n\x00y", " 12345678", " É"] + [
        f" w{i}" for i in range(5000)]
    _, size = tokens.library_encoder(packing.TOKENIZER)
    n_bytes = encoder.encode_stretches.__closure__ and next(
        c.cell_contents for c in encoder.encode_stretches.__closure__ if isinstance(c.cell_contents, np.ndarray))
    assert len(n_bytes) == size
    assert tokens.encode_joined(strings, encode, n_bytes) == encoder.encode_strings(strings)
    assert max(calls) < 10  # a few texts, not one per string
    calls.clear()
    assert tokens.encode_joined(strings, encode, n_bytes + 1) == encoder.encode_strings(strings)  # ends that are not reached
    assert tokens.encode_joined([], encode, n_bytes) == []


def test_documents_in_a_row_read_their_block_once(tmp_path):
    out = token_files.Writer(str(tmp_path / "a.ids"), 16, block=64)
    docs = [np.arange(n, dtype=np.uint32) for n in (5, 0, 7, 200, 1, 64, 3)]
    for i, ids in enumerate(docs):
        out.add(i, ids)
    out.close()
    reader = token_files.Reader(str(tmp_path / "a.ids"))

    class Counted:
        def __init__(self, file):
            self.file, self.reads = file, 0

        def read_at(self, *at):
            self.reads += 1
            return self.file.read_at(*at)

    reader.file = counted = Counted(reader.file)
    assert [reader.document(k).tolist() for k in range(len(docs))] == [d.tolist() for d in docs]
    assert counted.reads == len(reader.offsets) - 1
    assert reader.document(0).tolist() == docs[0].tolist()


def test_toxicity_collects_its_sample_as_arrow(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") + prose(i, 20)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")

    def refused(*_):
        raise AssertionError("the sample became Python objects in the driver")

    monkeypatch.setattr(type(docs), "toPandas", refused)
    model = toxicity.fit(docs, labels)
    assert len(model.words) and np.isfinite(model.weights).all()


def test_stretches_are_encoded_once_without_the_marks_behind_them():
    import re

    from fleetlint.llm import tokens

    given = []

    def encode(strings):
        given.extend(strings)
        return [np.array([ord(c) for c in s], "<u4").tobytes() for s in strings]

    cache = tokens.StretchCache(encode, entries=8)
    texts = ["one two, two. two; two", "two! one:two\n×. two.\nx..", "", " ", "é, я?! a.'s"]
    expected = [np.array([ord(c) for c in t], "<u4").tobytes() for t in texts]
    assert cache.encode_texts(texts) == expected
    assert given.count(" two") == 1 and not [s for s in given if re.search("[a-zéя][.,;:!?]", s)]
    for text, ids in zip(texts, expected, strict=True):  # with a memory that turns over
        assert cache.encode_texts([text]) == [ids]
    assert len(cache.known) <= 4 + 12


def test_words_given_to_the_model_match_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from fleetlint.llm import tokens

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    assert tokens.splits_words(library)
    texts = ["Thinking, thinkings; ÊTRE étionon. Übermaß! ñuestra пример, пример: ×÷ªº", "it's 'sable e.g. a.'s x.'ll 3.14, 7. ...a. ,b. \nab\n.",
             "<|endoftext|> a<|endoftext|>.", " a ", "ǅab ʯ. 中文. ǆ,", "a\x00b. \x00", "á. bͅ, \U00010d50. ٣."]
    cache, _ = tokens.library_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert cache.encode_texts(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_other_work_of_a_worker_drops_the_encoders():
    from fleetlint.llm import tables

    for load, path in ((tokens.library_encoder, packing.TOKENIZER), (byte_bpe.load, byte_bpe.RANKS)):
        load(path)
        assert load.cache_info().currsize
    assert tables._alone(list)("ab") == ["a", "b"]
    assert not tokens.library_encoder.cache_info().currsize and not byte_bpe.load.cache_info().currsize


def test_components_end_as_soon_as_stars_are_left(spark, monkeypatch):
    from fleetlint.llm import components as c

    stored, keep = [], c.materialise
    monkeypatch.setattr(c, "materialise", lambda df, name: stored.append(name) or keep(df, name))
    rng = random.Random(3)
    graphs = {"stars": ([(9, 1), (1, 7), (5, 2), (4, 4)], 1), "none": ([], 1), "two links up": ([(9, 1), (9, 2)], None), "chain": ([(i, i + 1) for i in range(40)], None),
              "any": ([(rng.randrange(200), rng.randrange(200)) for _ in range(180)], None)}
    for name, (links, rounds) in graphs.items():
        stored.clear()
        least = {x: x for link in links for x in link}
        for _ in least:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        got = {tuple(r) for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {(x, m) for x, m in least.items() if x != m}, name
        assert rounds is None or len(stored) == rounds, name
        if len(stored) > 1:  # no round that only confirms the one before
            tables = len(stored)
            again = c.components(spark.createDataFrame(sorted(got), "a long, b long"))
            assert {tuple(r) for r in again.collect()} == got and len(stored) == tables + 1
