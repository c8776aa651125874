import hashlib
import random

import duckdb
import sentencepiece
from pyspark.sql import functions as F

from leadloom.llm import counts, packing, pieces, sentencepieces
from leadloom.llm.common import tokenizer_path

ODD = ["", "  Hello  world\n <s> ▁a \x00 😀", "▁", "  ", "\n", "a\tb\r\n;\r", "<0x0A>", "</s><unk>", "x" * 3000, "ééé 日本語 𝔘𝔫𝔦", " ▁ ▁▁x", "1234567890 ,,,, ....", "á́ á", " 　 x", "👩‍👩‍👧‍👦 ok", "m² ².", "a’s “q”…"]


def documents(sf):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE text IS NOT NULL").fetchall()]


def test_pieces_equal_the_library(sf):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    model = pieces.load(tokenizer_path())
    encoder, decoder, counter = sentencepieces.Encoder(model), sentencepieces.Decoder(model), counts.Counter(model)
    for text in ODD + documents(sf):
        ids = encoder.ids(text)
        assert ids == library.encode(text) and decoder.decode(ids) == library.decode(ids) and counter.text(text) == len(ids)
        if len(text) < 3000:
            want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
            assert list(zip(*encoder.spans(text, ids))) == want, text
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randrange(8))]
        assert decoder.decode(ids) == library.decode(ids)


def test_normaliser_equals_the_library(sf):
    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        for trim in (True, False):
            library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
            model = pieces.PieceModel(library.serialized_model_proto())
            for text in [x for x in ODD if "\0" not in x] + ["ﬁ ½ Ａ  ㍿ ①"] + documents(sf)[:30]:
                normal, source = model.normalize(text)
                assert normal.decode() == library.normalize(text)
                assert len(source) == len(normal) + 1 and source == sorted(source) and source[-1] <= len(text.encode())


def test_no_cut_gives_the_same(sf):
    model = pieces.PieceModel(open(tokenizer_path(), "rb").read())
    cut, model.cut = model.cut, None
    assert cut is not None
    other = sentencepieces.Encoder(pieces.load(tokenizer_path()))
    assert all(sentencepieces.Encoder(model).ids(t) == other.ids(t) for t in ODD + documents(sf)[:20])


def test_queries(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    six = {r.doc_id: r for r in sentencepieces.op6_sentencepiece(spark, sf).collect()}
    ten = {r.doc_id: r for r in counts.op10_token_counts(spark, sf).collect()}
    assert set(six) == set(ten) == set(texts)
    for d, text in texts.items():
        ids = library.encode(text or "")
        assert (six[d].n_tokens, six[d].ids_sha256, six[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert (ten[d].n_bytes, ten[d].n_tokens, ten[d].over_limit) == (len((text or "").encode()), len(ids), len(ids) > 4096)


def test_queries_return_spans(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' WHERE length(text) < 3000").fetchall()
    want = {d: [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces] for d, t in docs}
    joined = {d: ";".join(",".join(str(x[k]) for x in w) for k in (0, 1)) for d, w in want.items()}
    six = {r.doc_id: r.spans_sha256 for r in sentencepieces.op6_sentencepiece(spark, sf).collect()}
    assert all(six[d] == hashlib.sha256(x.encode()).hexdigest() for d, x in joined.items())
    odd = [(k, t) for k, t in enumerate([*ODD, None]) if "\0" not in (t or "")]
    for r in sentencepieces.stage(spark, spark.createDataFrame(odd, "doc_id long, text string"), sf).collect():
        assert list(zip(r.starts, r.ends)) == [(p.begin, p.end) for p in library.encode(dict(odd)[r.doc_id] or "", return_type="proto").pieces]
    assert len(want) > 50


def test_defined_cases(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "hi there", "x"), (3, "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentencepieces.encode(df).collect()
    assert len(out) == 5 and sorted(len(r.ids) for r in out)[:3] == [0, 0, 0] and all(len(r.ids) == len(r.starts) == len(r.ends) for r in out)
    back = sentencepieces.decode(sentencepieces.encode(df)).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    counted = counts.count_tokens(df.withColumn("n_tokens", F.lit("clash"))).collect()
    assert sorted(r.n_tokens for r in counted)[:3] == [0, 0, 0] and len(counted) == 5
    assert sentencepieces.encode(df.limit(0)).count() == counts.count_tokens(df.limit(0)).count() == packing.packed(df.limit(0)).count() == 0
    packed = packing.packed(df, row=64).collect()
    assert sum(r.n_ids for r in packed) == sum(len(packing.tokenizer(tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary(t or "")) for _, t, _ in rows)


def test_packing_is_lossless(spark, sf):
    import numpy as np

    encode = packing.tokenizer(tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    rows = packing.op8_token_packing(spark, sf).collect()
    parts = {}
    for r in rows:
        line = np.frombuffer(r.ids, dtype="<i4")
        assert len(line) == packing.ROW and r.cu_seqlens[-1] == r.n_ids and r.positions == r.cu_seqlens[:-1]
        for d, at, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, []).append((at, line[a:b].tolist()))
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    for d, text in texts.items():
        assert [i for _, p in sorted(parts.get(d, [])) for i in p] == encode(text or "")
    assert len(rows) <= -(-sum(r.n_ids for r in rows) // packing.ROW) + 1


def test_rows_do_not_depend_on_splits(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(packing, "BUCKET_DOCS", 30)
    as_rows = lambda df: sorted((bytes(r.ids), r.cu_seqlens, r.doc_ids, r.offsets) for r in packing.packed(df, group_docs=12, row=256).collect())
    want = as_rows(docs.coalesce(1))
    assert want == as_rows(docs.repartition(7)) == as_rows(docs.orderBy("text").repartition(3, "text")) and len(want) > 50


def test_best_fit_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        row = rng.choice([1, 2, 7, 16, 33])
        lengths = [rng.randrange(0, 3 * row) for _ in range(rng.randrange(40))]
        rooms = []
        for n in sorted((n % row for n in lengths if n % row), reverse=True):
            fits = [r for r in rooms if r >= n]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else row) - n)
        got = packing.pack(lengths, row)
        assert len(got) == len(rooms) + sum(n // row for n in lengths)
        seen = {}
        for line in got:
            assert 0 < sum(n for _, _, n in line) <= row
            for d, at, n in line:
                seen.setdefault(d, []).append((at, n))
        assert all(sum(n for _, n in seen.get(d, [])) == n for d, n in enumerate(lengths))
