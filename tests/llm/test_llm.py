import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from groveline.llm import byte_bpe, decontaminate, html_extract, language_id, line_dedup, minhash_dedup, quality_rules, secret_scan, substring_dedup, warc_archive

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    words = lambda k: " ".join(rnd.choice(vocab) for _ in range(k)) + "."
    shared = [words(16), words(30)]
    out = []
    for i in range(n):
        kind = rnd.random()
        if out and kind < 0.3:
            own = rnd.choice(out)[1].split(" ")
            for _ in range(rnd.choice((0, 0, 1, 2, 3))):
                own[rnd.randrange(len(own))] = "new" + str(rnd.randrange(99))
            text = " ".join(own)
        else:
            text = "\n".join([words(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 4))] + ([rnd.choice(shared)] if rnd.random() < 0.4 else []))
        out.append((i, text))
    rnd.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


ODD = [(None, "a b c"), (900, None), (901, ""), (902, " \n\t"), (903, "word"), (904, "x " * 30000), (904, "x " * 30000), (905, "ünï " * 40)]


@pytest.fixture(scope="module")
def rows():
    return corpus() + ODD


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key(i, *more):
    return (-1 if i is None else i, *more)


def test_secrets(spark):
    hexes, mixed = "9f86d081884c7d659a2feaa0c55ad015", "aB3dE5fG7hJ9kL1mN3pQ5rS7"
    texts = [f'é token = "{hexes}" end', f"AKIA{'A1' * 8} password:short", f"x {mixed} y", "123e4567-e89b-12d3-a456-426614174000", None, "", "a" * 50, f"token=a.password: {'z' * 14}"]
    out = {r.doc_id: r for r in secret_scan.secret_scan(frame(spark, list(enumerate(texts))).withColumn("_hex", F.lit(1))).collect()}
    spans = {i: [(secret_scan.KINDS[s.k], s.a, s.b) for s in r.secrets] for i, r in out.items()}
    assert spans[0] == [("assign", 2, 2 + 9 + len(hexes)), ("hex", 11, 11 + len(hexes)), ("entropy_hex", 11, 11 + len(hexes))]
    assert ("access", 0, 20) in spans[1] and not any(k == "assign" for k, *_ in spans[1])
    assert [k for k, *_ in spans[2]] == ["entropy_mixed"]
    assert not any(k.startswith("entropy") for k, *_ in spans[3])
    assert spans[4] == spans[5] == [] and spans[7] == []
    assert [s for s in spans[6]] == [("hex", 0, 50)]
    assert secret_scan.secret_scan(frame(spark, [])).count() == 0


def brute_substring(rows):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for j in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[j : j + 13])] < i:
                keep[j : j + 13] = [False] * 13
        out.append(key(i, len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, rows, batches):
    rows = rows + [(950, "x " * 20), (5, "quite another text under an id that is used twice " * 2)]
    got = substring_dedup.substring_dedup(frame(spark, rows), batches).collect()
    assert sorted(key(*r) for r in got) == brute_substring(rows)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_quality_rules(spark, rows):
    got = quality_rules.quality_rules(frame(spark, rows).withColumn("quality", F.lit(1))).collect()
    for r in got:
        w = WORD.findall(r.text or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        counts = Counter(windows)
        assert r.quality.n_repeat_words == len({i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(8)})
        assert r.quality.base_failed == (len(w) < 20 or 100 * r.quality.n_repeat_words > 30 * len(w))
    junk = "Home | About | News | Contact\nAll rights reserved.\nBUY!! NOW!! CHEAP!!\n"
    clean = "A sentence of plain words that stays as it was written in the text, one of several.\n" * 1
    body = clean + "Another line follows it and has enough words to count, as lines should."
    q = quality_rules.judge(junk + body)
    assert q[6] and q[7] == body
    assert not quality_rules.judge(junk * 9 + " ".join(f"{i}word" for i in range(21)))[6]


def test_bpe_is_tiktoken(spark, rows):
    bpe = byte_bpe.load()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aabcdeir nst\n\t '1é日ß\x1c\x85 🙂") for _ in range(rnd.randrange(90))) for _ in range(400)] + ["a" * 20000, "ab" * 3000, " " * 500]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == enc.encode_ordinary(t)
    for r in byte_bpe.decode(byte_bpe.encode(frame(spark, rows))).collect():
        assert bytes(r.decoded) == (r.text or "").encode()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_in_polynomials(spark):
    """A Thue-Morse word and its complement have one hash modulo 2**64 whatever the base: they must count as different."""
    word, other = thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))
    rest = " one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, word + rest), (2, other + rest), (3, word + rest)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    near = {r.doc_id: r.component_id for r in minhash_dedup.minhash_dedup(frame(spark, [(1, word), (2, other), (3, word)])).collect()}
    assert near == {1: 1, 2: 2, 3: 1}


def test_an_index_that_lasts(spark):
    """Two calls on one folder remove what one call on both batches removes."""
    rows = sorted(corpus(4, 50))
    old, new = rows[:30], rows[30:]
    root = substring_dedup.scratch(spark)
    whole = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    parts = {}
    for batch in (old[:15], old[15:], new):
        parts |= {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(frame(spark, batch), 1, root=root).collect()}
    assert parts == whole and any(n for n, _ in whole.values())
    assert 0 < len([p for p in substring_dedup.children(spark, root) if "/run-" in p]) <= 2


def test_archive(spark):
    long = "é" * 60
    pages = [(5, "u", long), (2, "u\r\nX: y", long), (7, None, "tiny"), (8, "u", "tiny"), (9, "u", None), (None, "u", long), (2, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    root = warc_archive.scratch(spark)
    warc_archive.write_archive(df, root)
    assert spark.read.parquet(f"{root}/payloads").count() == 3
    back = warc_archive.read_archive(spark, root).collect()
    assert sorted((key(r.page_id), bytes(r.stored).decode()) for r in back) == sorted((key(i), h or "") for i, _, h in pages)
    read = warc_archive.parse_records(warc_archive.read_archive(spark, root)).collect()
    assert len({r.record_id for r in read}) == len(pages)
    named = {r.record_id: r for r in read}
    for r in read:
        other = named.get(r.refers_to_record)
        revisit = bytes(r.payload).decode() == long and r.page_id != 2
        assert r.record_type == ("revisit" if revisit else "response") and (other.page_id == 2 and other.record_type == "response" if revisit else other is None)
        assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest
    empty = warc_archive.scratch(spark)
    warc_archive.write_archive(df.limit(0), empty)
    assert warc_archive.parse_records(warc_archive.read_archive(spark, empty)).count() == 0
    for r in back:
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert record.startswith(b"WARC/1.1\r\n") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n") and b"X: y" not in head.split(b"\r\n")
    warc_archive.export_warc(spark, root, root + "/warc")
    assert spark.read.option("lineSep", "WARC/1.1\r\n").text(root + "/warc").filter("length(value) > 0").count() == len(pages)
    broken = spark.read.parquet(f"{root}/payloads").withColumn("payload", F.lit(b"x"))
    broken.write.parquet(f"{root}-2/payloads")
    spark.read.parquet(f"{root}/headers").write.parquet(f"{root}-2/headers")
    with pytest.raises(Exception, match="broken payload"):
        warc_archive.read_archive(spark, f"{root}-2").select("stored").collect()


def union(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_line_dedup(spark, rows):
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    lines = list(dict.fromkeys(x for _, t in known for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")))
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    roots = dict(zip(lines, union(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])))
    owner, want = {}, []
    for i, t in known:
        out, n, gone, own = [], 0, 0, set()
        for x in (t or "").split("\n"):
            if not x.strip(" \t\n\v\f\r"):
                out.append(x)
                continue
            n += 1
            if owner.setdefault(roots[x], i) < i or roots[x] in own:
                gone += 1
            else:
                own.add(roots[x])
                out.append(x)
        want.append((i, n, gone, "\n".join(out) if t is not None else None))
    got = [tuple(r) for r in line_dedup.line_dedup(frame(spark, rows)).collect() if r.doc_id is not None]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def brute_near(rows):
    nodes = sorted({i for i, _ in rows if i is not None})
    at = {i: k for k, i in enumerate(nodes)}
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    links = [(at[rows[a][0]], at[rows[b][0]]) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = union(len(nodes), links)
    least = {}
    for i, r in zip(nodes, roots):
        least[r] = min(least.get(r, i), i)
    return sorted((key(i), len(s), key(i) if i is None else least[roots[at[i]]]) for (i, _), s in zip(rows, sets))


def test_near_duplicates(spark, rows):
    got = minhash_dedup.minhash_dedup(frame(spark, rows)).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == [(a, n, c) for a, n, c in [(x[0], x[1], x[2] if isinstance(x[2], tuple) else (x[2],)) for x in brute_near(rows)]]
    assert minhash_dedup.minhash_dedup(frame(spark, [])).count() == 0


def test_tiling():
    p = list(range(1, 21))
    assert decontaminate.tile(p, [*p[10:], None, *p[:10]]) == 20
    assert decontaminate.tile(p, p[:10]) == 10
    assert decontaminate.tile(p, [1, 2, 3, 99, 4, 5, 6]) == 0
    assert decontaminate.tile([1, 2, 3, 4] * 2, [1, 2, 3, 4]) == 4


def test_decontamination(spark, monkeypatch):
    items = [(1, "One two three four five six seven eight nine ten."), (2, "tiny item"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(0, "text before. Six, seven eight NINE ten! and one two three four five after"), (1, "one two three four only"), (2, "tiny item"), (3, None), (4, "x alpha beta gamma delta epsilon zeta eta theta y"), (5, "")]
    df = frame(spark, docs).withColumn("items", F.lit(1)).withColumn("row", F.lit(2))
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [1, 2, 3, 5]
    found = {r.doc_id: [(x.item_id, x.covered, x["size"]) for x in r["items"]] for r in decontaminate.find_contamination(frame(spark, docs), bench).collect()}
    assert found[0] == [(1, 10, 10)] and found[4] == [(4, 8, 8)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    again = {r.doc_id: [(x.item_id, x.covered, x["size"]) for x in r["items"]] for r in decontaminate.find_contamination(frame(spark, docs), bench).collect()}
    assert again == found
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_blocks_do_not_change_rows(spark, monkeypatch):
    """Repeated and null ids, and repeated items, give the same rows in one block and in several."""
    one, two = "one two three four five six", "alpha beta gamma delta epsilon"
    bench = spark.createDataFrame([(1, one), (1, one), (2, two), (None, two)], "item_id long, text string")
    docs = frame(spark, [(None, one), (None, two), (None, "clean"), (7, one), (7, two), (8, "clean"), (8, "clean"), (9, f"{two} {one}"), (9, None)])
    found = lambda: sorted(str(tuple(r)) for r in decontaminate.find_contamination(docs, bench).collect())
    left = lambda: sorted(str(tuple(r)) for r in decontaminate.decontaminate(docs, bench).collect())
    whole, clean = found(), left()
    assert len(whole) == 9 and len(clean) == 4
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert found() == whole and left() == clean


def test_block_labels(spark):
    model = html_extract.trained()
    xs, ys = html_extract.samples(200, 77)
    good = sum(int((a == (b > 0)).sum()) for a, b in zip(model.label(xs), ys))
    assert good >= 0.97 * sum(map(len, ys))
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><script>x("</p>")</script><article><h1>Head &amp; line</h1><p>First  para\ngraph<br>goes on here.<p>Second <b>one</b> follows it.</article><footer>&copy; site</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page)], "page_id long, url string, html string")
    got = sorted(html_extract.extract(df).collect(), key=lambda r: r.page_id)
    want = "Head & line\n\nFirst para graph goes on here.\n\nSecond one follows it."
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]


def test_language(spark):
    out = language_id.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, ODD), language_id.train([])).collect()}
    assert set(odd.values()) == {"und"}
    model = language_id.fit(frame(spark, [(1, "the and of"), (2, None), (3, "1 2 3")]))
    assert [r.lang_pred for r in language_id.identify(frame(spark, [(1, "123 !"), (2, None), (3, "words")]), model).orderBy("doc_id").collect()] == ["und", "und", "en"]


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, d))
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and 0 < out.count() <= docs.count(), name
        docs = out
    assert all(r.exact for r in corpus_pipeline.tokens(spark, docs, d).select("exact").collect())


@pytest.mark.parametrize("stage", ["line_dedup", "minhash_near_dedup"])
def test_stages_keep_rows_of_null_and_repeated_ids(spark, stage):
    """Each row keeps its own text, lang and source, whatever its id."""
    text = lambda k: " ".join(f"{k}{chr(97 + i)}word" for i in range(12))
    rows = [(None, text("p"), "en", "a"), (None, text("q"), "de", "b"), (1, text("r"), "fr", "c"), (1, text("s"), "es", "d"), (1, text("s"), "es", "e"), (2, text("t"), "en", "f")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs.union(spark.createDataFrame([(3, text("t"), "en", "g", 1)], SCHEMA)), "")
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((*r, len(r[1]))) for r in rows)


@pytest.mark.parametrize("crowded, held", [(8, 1 << 20), (0, 40), (2, 300)])
def test_buckets_keep_all_members(monkeypatch, crowded, held):
    """Blocks packed by several tasks, crowded bands bound in their task or not: buckets as a plain grouping gives them."""
    from groveline.llm import _links

    monkeypatch.setattr(_links, "CROWDED", crowded)
    monkeypatch.setattr(_links, "HELD", held)
    monkeypatch.setattr(_links, "EVERY", 1 if crowded < 8 else 11)
    rnd, rows, blocks = random.Random(3), set(), []
    for task in range(4):
        packer = _links.Packer(7)
        own = [(i, [rnd.choice((5, 9 << 41, rnd.randrange(40) << 40)), 1000 + i]) for i in rnd.sample(range(90), 40)]
        for k in range(0, 40, 8):
            part = own[k : k + 8]
            blocks += packer.add(np.array([b for _, b in part], np.uint64), np.array([i for i, _ in part], np.int64))
        blocks.append(packer.flush())
        rows |= {(b, i) for i, bs in own for b in bs}
    table = pa.Table.from_batches(blocks).sort_by("part").to_batches(max_chunksize=3)
    got = {(r["band"], r["id"], r["least"]) for b in _links._buckets(iter(table)) for r in b.to_pylist()}
    want = {(b, i) for b, i in rows if sum(c == b for c, _ in rows) > 1}
    assert {(b, i) for b, i, _ in got} == want
    # What is told of a bucket connects it: stars over stars.
    nodes = sorted(want)
    roots = union(len(nodes), [(nodes.index((b, i)), nodes.index((b, m))) for b, i, m in got])
    assert len(set(roots)) == len({b for b, _ in want}) and all(i >= m for _, i, m in got)


def test_many_similar_lines(spark, monkeypatch):
    """A large group of variants, of which some are unlike most others: random tries change no result."""
    from groveline.llm import _links

    rnd = random.Random(5)
    base = [rnd.choice(("alpha", "beta", "gamma", "delta", "omega", "sigma")) + str(k) for k in range(24)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(24), rnd.choice((0, 1, 2, 3, 4))):
            own[k] = "".join(rnd.choice("uvwxyz") for _ in range(6))
        rows.append((i, " ".join(own)))
    plain = sorted(map(tuple, line_dedup.line_dedup(frame(spark, rows)).collect()))
    monkeypatch.setattr(_links, "WORTH", 0)
    monkeypatch.setattr(_links, "LESS", 0.95)
    monkeypatch.setattr(_links, "CROWDED", 0)
    assert sorted(map(tuple, line_dedup.line_dedup(frame(spark, rows)).collect())) == plain
    lines = [t for _, t in rows]
    sets = [line_dedup._set(x) for x in lines]
    roots = union(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.similar(sets[i], sets[j])])
    first = {}
    assert [r[2] for r in plain] == [int(first.setdefault(roots[i], i) < i) for i in range(len(rows))]


def test_recall_of_bands_and_sketches(spark):
    """Pairs of lines just above the threshold: nearly all share a band, and bitmaps never rule one out."""
    rnd, found, good = random.Random(9), 0, 0
    for _ in range(1500):
        line = "".join(rnd.choice("abcdefghij klmnop") for _ in range(rnd.choice((25, 60, 120, 400)))).strip() or "x"
        other = list(line)
        for _ in range(rnd.randint(1, 1 + len(line) // 45)):
            other[rnd.randrange(len(other))] = rnd.choice("qrstu")
        other = "".join(other)
        if not line_dedup.similar(line_dedup._set(line), line_dedup._set(other)):
            continue
        low, of = line_dedup._shingles([line, other])
        bands = line_dedup._bands(line_dedup._signatures(low, of, 2))
        n, odd = line_dedup._parity(low, of, 2)
        far, most = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum()), int(n.sum()) * 20 / 180
        assert far <= most + 1e-6 and list(n) == [len(line_dedup._set(x)) for x in (line, other)]
        good += 1
        found += bool((bands[0] == bands[1]).any())
    assert good > 300 and found >= 0.99 * good


def test_page_parts():
    """Formulas stay in their paragraph, controls and scripts go, tags without an end take linear time."""
    texts = lambda page: [t for _, t, _ in html_extract.blocks(page)]
    assert texts("<article><p>Let <math>x</math> be 5 and <svg><text>y</text></svg>.</p></article>") == ["Let x be 5 and y."]
    assert texts("<datalist><option value=a>A<option value=b>B</datalist><p>Text</p><script>no</script><noscript>shown</noscript>") == ["Text", "shown"]
    assert html_extract.blocks("<div hidden>x</div>")[0][0][-1] == "hidden"
    assert texts("<p>a</p><script>let x") == ["a"] and texts("") == [] and texts("<a title='x < y'>t</a>") == ["t"]
    import time

    for bad in ("<a ", '<a "', "<!--x", "<a '>", "<p"):
        start = time.perf_counter()
        html_extract.blocks(bad * 20000)
        html_extract.blocks(bad * 20000 + ">")
        assert time.perf_counter() - start < 5


def test_rules_read_ascii_classes_alike():
    import duckdb

    lines = ["é menu é", "copyright\u00a0(c)", "copyright (c) 2020", "prıvacy polıcy", "PRIVACY policy", "Menu", "- Home -", "ſubscribe to our", "a | b | c | d | e", "## ## !!"]
    text = " ".join(f"w{i}" for i in range(30))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(0, ?)) AS doc_id, unnest(?) AS text", [len(lines), [f"{text}\n" * 1 + f"{x}\n{x} {text}" for x in lines]])
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.SQL})").fetchall()}
    assert want == {i: quality_rules.judge(f"{text}\n{x}\n{x} {text}")[6] for i, x in enumerate(lines)}


def test_pre_tokens_share_a_queue(monkeypatch):
    """Pre-tokens of many texts are merged in one go, with the ids that each has alone."""
    rnd, bpe = random.Random(8), byte_bpe.ByteBPE(byte_bpe.load().ranks, public_tokenizers.PATTERN)
    texts = ["", *(" ".join("".join(rnd.choice("aehinorst\u00e9\u4e2d") for _ in range(rnd.randrange(1, 30))) for _ in range(40)) for _ in range(30)), "a" * 5000, "ab" * 3000]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    calls, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda pieces: calls.append(len(pieces)) or merge(pieces))
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_all(texts)] == [enc.encode_ordinary(t) for t in texts]
    assert len(calls) == 1 and calls[0] > 500


def test_one_worker_encodes_and_decodes(spark, rows):
    """One Python step a task, which gives the rows of two, and after which no pre-token is held."""
    out = byte_bpe.round_trip(frame(spark, rows))
    assert out._jdf.queryExecution().toString().split("Physical Plan")[1].count("MapInArrow") == 1
    two = byte_bpe.decode(byte_bpe.encode(frame(spark, rows)))
    assert sorted(map(str, out.collect())) == sorted(map(str, two.collect()))
    bpe = byte_bpe.load()
    bpe.encode("some words that are remembered wxqzj")
    assert bpe.memory and bpe.pairs
    bpe.forget()
    assert not (bpe.memory or bpe.older or bpe.pairs)


def test_written_shuffles_leave_no_files(spark):
    """Shuffle files of a scratch table go once it is written, whether or not the driver collects its garbage."""
    import time

    from groveline.llm import _shared

    files = lambda: sum(1 for _ in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in _.getName())
    before, frame_ = files(), spark.range(5000).repartition(7, "id")
    out = _shared.cut(frame_)
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.1)
    assert files() <= before and out.count() == 5000


def test_pairs_grow_with_lines(spark, monkeypatch):
    """A group of n near copies gives pairs in proportion to n, not to its square."""
    from groveline.llm import _links

    cut, pairs = _links.cut, []

    def counted(df, **more):
        out = cut(df, **more)
        if {"a", "b"} <= set(df.columns):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(_links, "cut", counted)
    rnd = random.Random(6)
    base = [f"{rnd.choice(('alpha', 'beta', 'gamma'))}{k}" for k in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]])) for i in range(200)]
    out = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert sum(r.n_removed for r in out) == 199
    assert pairs and max(pairs) <= 10 * len(rows)


def test_pairs_of_open_buckets_come_once(spark, monkeypatch):
    """Two lines that share many open buckets are one row of their join, without a step that drops repeats."""
    from groveline.llm import _links

    cut, pairs = _links.cut, []

    def counted(df, **more):
        out = cut(df, **more)
        if {"a", "b", "low", "high"} <= set(df.columns):
            assert "Deduplicate" not in df._jdf.queryExecution().logical().toString().split("Join")[0]
            pairs.append([frozenset((r.a, r.b)) for r in out.collect()])
        return out

    components, calls = _links.components, []
    # As if no try at least ids had linked anything: all buckets of three and more are open.
    monkeypatch.setattr(_links, "components", lambda edges: calls.append(1) or components(edges.limit(0) if len(calls) == 1 else edges))
    monkeypatch.setattr(_links, "cut", counted)
    rnd = random.Random(5)
    base = [f"{rnd.choice(('alpha', 'beta', 'gamma', 'delta'))}{k}" for k in range(24)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(24), rnd.choice((0, 1, 2, 3, 4))):
            own[k] = "".join(rnd.choice("uvwxyz") for _ in range(6))
        rows.append((i, " ".join(own)))
    line_dedup.line_dedup(frame(spark, rows)).collect()
    assert pairs and pairs[0] and len(pairs[0]) == len(set(pairs[0]))


def test_members_are_joined_once_a_round(spark, monkeypatch):
    """A round joins each member once with its component, and a later one only those of buckets that were still open."""
    from groveline.llm import _links

    cut, open_, joins, rounds = _links.cut, _links._open, [], []

    def counted(df, **more):
        joins[-1] += df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
        return cut(df, **more)

    def watched(rows, known, turn, path):
        joins.append(0)
        members = rows.count()
        with monkeypatch.context() as m:
            m.setattr(_links, "cut", counted)
            out, cost, size = open_(rows, known, turn, path)
        rounds.append((members, size))
        return out, cost, size

    monkeypatch.setattr(_links, "_open", watched)
    monkeypatch.setattr(_links, "WORTH", 0)
    monkeypatch.setattr(_links, "LESS", 0.95)
    rnd = random.Random(5)
    base = [rnd.choice(("alpha", "beta", "gamma", "delta", "omega", "sigma")) + str(k) for k in range(24)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(24), rnd.choice((0, 1, 2, 3, 4))):
            own[k] = "".join(rnd.choice("uvwxyz") for _ in range(6))
        rows.append((i, " ".join(own)))
    # A bucket of three copies but for one word is closed from the start.
    rows += [(200 + i, " ".join([f"other{k}" for k in range(60)] + [f"x{i}"])) for i in range(3)]
    line_dedup.line_dedup(frame(spark, rows)).collect()
    assert len(rounds) > 1 and rounds[0][1] < rounds[0][0]
    assert joins == [1] * len(rounds)
    assert all(members == size for (_, size), (members, _) in zip(rounds, rounds[1:], strict=False))
