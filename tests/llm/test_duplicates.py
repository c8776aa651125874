import random
from collections import Counter, defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from leadloom.llm import decontaminate, minhash, shingles, substrings
from leadloom.llm.bwt import repeated_starts

SCHEMA = "doc_id long, text string, node string"


def classes(rows):
    """Brute force over an index of shingles."""
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    bags, index, first = shingles.bags([t for _, t in rows]), defaultdict(list), {}
    for i, (_, t) in enumerate(rows):
        if t in first:
            top[find(i)] = find(first[t])
            continue
        first[t] = i
        near = Counter(j for s in bags[i][0].tolist() for j in index[s])
        for s in bags[i][0].tolist():
            index[s].append(i)
        for j in near:
            both, either = shingles.overlap(bags[i], bags[j])
            if 5 * both >= 4 * either and find(i) != find(j):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def test_signatures_are_unbiased():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(2000)]
    off = []
    for k in range(30):
        base = [rng.choice(words[: 60 if k % 2 else 2000]) for _ in range(300)]
        other = [rng.choice(words) if rng.random() < 0.03 else w for w in base]
        a, b = shingles.bags([" ".join(base), " ".join(other)])
        if k % 3 == 0:
            a, b = ((x, c * 3 + (x % np.uint64(m)).astype(np.int64)) for (x, c), m in ((a, 5), (b, 7)))
        both, either = shingles.overlap(a, b)
        j = both / either
        sign = minhash.signatures([a, b], 2048)
        off.append(((sign[0] == sign[1]).mean() - j) / max(1e-9, (j * (1 - j) / 2048) ** 0.5))
    assert abs(np.mean(off)) < 0.6 and np.std(off) < 1.5


def test_near_duplicates_against_brute_force(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    rng = random.Random(2)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    # a large loose group: most of its members are near the base, and few near each other
    for i in range(250):
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_000, None), (20_001, None), (20_002, ""), (20_003, "One two"), (20_004, "one  TWO"), (None, "one two"), (20_003, "One two"), (20_005, "word " * 30_000), (20_006, "word " * 29_000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = defaultdict(list)
    for r in minhash.near_duplicates(df).collect():
        got[r.doc_id].append(r.class_id)
    want = defaultdict(list)
    for (d, _), c in zip(rows, classes(rows)):
        want[d].append(c)
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_transform_against_brute_force():
    rng = random.Random(0)
    for _ in range(150):
        n = rng.choice([3, 5, 9, 20])
        blocks = [bytes(rng.choice(b"ab\0c") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 8))]
        for _ in range(rng.randrange(4)):
            x = rng.choice(blocks)
            at = rng.randrange(len(x) + 1)
            blocks.append(bytes(rng.choice(b"abz") for _ in range(rng.randrange(5))) + x[at : at + 30])
        seen = Counter(b[i : i + n] for b in blocks for i in range(len(b) - n + 1))
        assert [g.tolist() for g in repeated_starts(blocks, n)] == [[i for i in range(len(b) - n + 1) if seen[b[i : i + n]] > 1] for b in blocks]


def removed(rows, n=200):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                cover[i] += 1
                cover[i + n] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_removal_against_brute_force(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id LIMIT 120").fetchall()
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage = prose(70)
    rows += [(1000 + i, prose(rng.randrange(40)) + passage[rng.randrange(40) :] + prose(rng.randrange(40))) for i in range(25)]
    rows += [(2000, "a" * 5000), (2001, "line of text\n" * 300), (2002, None), (2003, ""), (2004, "x\0y" * 200), (2004, "x\0y" * 200), (None, passage)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    want = sorted((str(d), *w) for (d, _), w in zip(rows, removed(rows)))
    for hot in (substrings.HOT, 4):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df, hot=hot).collect())
        assert got == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcdef ") for _ in range(6000))
    whole = {(int(p) >> 10) + k for p in substrings.runs(text)[0] for k in range(int(p) & 511)}
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    place, anchor, block = substrings.runs(text)
    assert {(int(p) >> 10) + k for p in place for k in range(int(p) & 511)} == whole == set(range(len(text) - 199))


def test_recall_of_leaks(sf):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    filler = decontaminate.words(duckdb.sql(f"SELECT string_agg(text, ' ') FROM '{sf}/documents.parquet'").fetchall()[0][0])
    detector, rng = decontaminate.Detector(items), random.Random(3)
    found = total = false = 0
    for _ in range(400):
        item, text = rng.choice(items)
        words = decontaminate.words(text)
        most = int(0.2 * len(words) + 1e-9)
        copy = list(words)
        for _ in range(rng.randrange(most + 1)):
            at, kind = rng.randrange(len(copy)), rng.randrange(3)
            copy[at : at + (kind < 2)] = [] if kind == 1 else [f"new{rng.randrange(999)}"]
        start = rng.randrange(len(filler) - 200)
        doc = filler[start : start + 60] + copy + filler[start + 60 : start + 120]
        distance = decontaminate.fit_distance(decontaminate.hashes_of(words), decontaminate.hashes_of(doc))[0]
        hits = {x["item_id"]: x["n_edits"] for x in detector.detect([" ".join(doc)])[0]}
        total += distance <= most
        found += item in hits
        false += any(n > int(0.2 * len(decontaminate.words(dict(items)[i])) + 1e-9) for i, n in hits.items())
    assert total > 300 and found >= 0.99 * total and not false


def test_long_leaks_at_the_greatest_distance():
    rng = random.Random(11)
    sizes = [size for size in (100, 150, 200, 300, 500) for _ in range(4)]
    items = [(k, " ".join(f"i{k}w{j}" for j in range(size))) for k, size in enumerate(sizes)]
    detector = decontaminate.Detector(items)
    for kind in ("deletions", "insertions", "mixed"):
        docs = []
        for k, size in enumerate(sizes):
            copy, most = decontaminate.words(items[k][1]), size // 5
            places = sorted(rng.sample(range(1, size - 1), most), reverse=True)
            for n, at in enumerate(places):
                change = kind if kind != "mixed" else ("deletions", "insertions")[n % 2]
                copy[at : at + (change == "deletions")] = [] if change == "deletions" else [f"new{k}x{n}"]
            docs.append([f"f{k}w{j}" for j in range(30)] + copy + [f"g{k}w{j}" for j in range(30)])
        for k, hits in enumerate(detector.detect([" ".join(d) for d in docs])):
            # without keys: the least distance to any run of the whole text
            distance, end = decontaminate.fit_distance(detector.words[k], decontaminate.hashes_of(docs[k]))
            assert distance <= sizes[k] // 5 and (kind == "mixed" or distance == sizes[k] // 5)
            assert hits == [{"item_id": k, "n_edits": distance, "end_word": end}], (kind, sizes[k])


def test_a_phrase_of_many_items_proposes_none_of_them():
    stem = "which of these statements about the following passage is true"
    items = [(k, f"{stem} " + " ".join(f"i{k}w{j}" for j in range(30))) for k in range(300)]
    detector = decontaminate.Detector(items)
    texts = [" ".join(f"{stem} " + " ".join(f"f{k}x{n}w{j}" for j in range(20)) for n in range(5)) for k in range(10)] + [f"intro {items[7][1]} outro"]
    all_words = [w for t in texts for w in decontaminate.words(t)]
    ends = np.cumsum([len(decontaminate.words(t)) for t in texts])
    assert {i for _, i, _ in detector.windows(decontaminate.hashes_of(all_words), ends).tolist()} == {7}
    assert [[x["item_id"] for x in hits] for hits in detector.detect(texts)] == [[]] * 10 + [[7]]


def test_leaks_of_defined_cases(spark, sf):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "solo"), (None, "one two three four five six")], "item_id long, text string")
    rows = [(1, "x Alpha beta, gamma delta epsilon zeta eta theta iota kappa! y", "c"), (2, None, "c"), (3, "alpha beta gamma", "c"), (None, "a solo b", "c"), (5, "one two three four five six", "c"), (5, "one two three four five six", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for block, blocks in ((4_000_000, 8), (30, 8), (30, 1)):
        got = decontaminate.leaks(df, bench, block_bytes=block, pass_blocks=blocks).collect()
        assert sorted((str(r.doc_id), sorted(str(x.item_id) for x in r["__leaks"])) for r in got) == [("1", ["1"]), ("2", []), ("3", []), ("5", ["None"]), ("5", ["None"]), ("None", ["4"])]
    assert decontaminate.leaks(df, bench.limit(0)).count() == 6 and decontaminate.leaks(df.limit(0), bench).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    import sentencepiece

    from leadloom.llm.common import tokenizer_path
    from tests.llm.test_quality_pii import measures, spans

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    good = [(d, t) for d, t in docs if (m := measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    good = [(d, t) for (d, t), c in zip(good, classes(good)) if c == d]
    detector = decontaminate.Detector(duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall())
    good = [(d, t) for (d, t), hits in zip(good, detector.detect([t for _, t in good])) if not hits]
    want = {}
    for d, t in good:
        out, end = "", 0
        for kind, a, b in (s.split(":") for s in spans(t).split(",") if s):
            if int(a) >= end:
                out += t[end : int(a)] + f"[{kind.upper()}]"
            end = max(end, int(b))
        want[d] = library.encode(out + t[end:])
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def words_of(text):
    return [w for x in (text or "").lower().split() if (w := x.strip(decontaminate.EDGES))]


def least_edits(item, text):
    """Edit distance of ``item`` to the nearest run of ``text``, word by word."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_query_against_edit_distance(spark, sf):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    texts, want = {d: words_of(t) for d, t in docs}, set()
    for i, text in items:
        item = words_of(text)
        most = int(0.2 * len(item) + 1e-9)
        for d, t in texts.items():
            # fewer common words than an occurrence has: no need for the table
            if item and len(item) - sum((Counter(item) & Counter(t)).values()) <= most and (n := least_edits(item, t)) <= most:
                want.add((d, i, n))
    got = {(r.doc_id, r.item_id, r.n_edits) for r in decontaminate.op7_decontamination(spark, sf).collect()}
    assert got == want and want


def test_stages_keep_columns_and_cases(spark, sf):
    """Nulls, empty and long texts, repeated rows and columns with the names of inner ones, at every stage."""
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(1, good, "s"), (1, good, "s"), (2, None, "s"), (3, "", None), (None, good + " x y", None), (5, " ".join(f"v{i}" for i in range(40_000)), "t")]
    names = ["n_words", "base", "added", "__leaks", "node", "component", "buckets", "ids", "starts", "decoded", "n_tokens", "kept", "rejected", "host", "class_id"]
    docs = spark.createDataFrame([(*r, *[f"{n} {r[0]}" for n in names]) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        if name != "token ids":
            assert out.columns == docs.columns, name
            assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in names), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        ids = sorted(str(r.doc_id) for r in got)
        assert ids == {"quality rules": ["1", "1", "5", "None"], "near duplicates": ["1", "2", "3", "5"]}.get(name, ["1", "1", "2", "3", "5", "None"]), name
