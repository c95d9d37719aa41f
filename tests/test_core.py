"""Core operators against independent statements of their rules."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F
from scriven.functions import text as T
from scriven.operators import chunks, evaluate, index, records, report, rewrite, similarity, web
from scriven.sources import files, harvest
from scriven.streaming import stateful


def split_plainly(text):
    out, start, quoted, i = [], 0, False, 0
    while i < len(text):
        c = text[i]
        if c in "“”\"‘’":
            quoted = not quoted
        elif not quoted and (c in "。！？；!?;" or c == "." and not text[i + 1 : i + 2].isalnum()):
            out.append((start, i + 1))
            start = i + 1
        elif not quoted and c == "\n":
            out.append((start, i))
            start = i + 1
        i += 1
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


CASES = ["a.b. c! d", "“A.B。C”后。末", "It’s one. two.", "x\n\n y.\n", "none", "3.14 is; ok?! yes.", "open “quote. never\n", "  。", "a.”b. c", "", "中文很长。Next one"]


def test_split(spark):
    rng = random.Random(1)
    texts = CASES + ["".join(rng.choice("aé1. \n。!“”\"中,") for _ in range(rng.randint(0, 50))) for _ in range(300)] + ["word " * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(10_000, None, "x")], "doc_id bigint, text string, idx string")
    got = {}
    for r in index.sentences(df).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
        assert r.text == texts[r.doc_id][r.start_pos : r.end_pos]
    assert got == {i: s for i, t in enumerate(texts) if (s := split_plainly(t))}
    assert index.sentences(df.where("false")).count() == 0


def test_shingles(spark):
    rows = [("zh", "一二三四五"), ("zh", "一二三四五六"), ("zh", "一二三四五六七八九"), ("en", "a b c d e"), ("en", "a b c d e f g"), ("en", "a a a a a a a a"), ("en", "")]
    df = spark.createDataFrame(rows, "kind string, norm string")
    n = T.units(F.col("norm"), F.col("kind"))
    got = {r.norm: r.s for r in df.select("norm", T.shingles(F.col("norm"), F.col("kind"), n).alias("s")).collect()}
    assert got == {"一二三四五": [], "一二三四五六": ["一二三四五六"], "一二三四五六七八九": ["一二三四五六七八", "二三四五六七八九"], "a b c d e": [], "a b c d e f g": ["a b c d e f", "b c d e f g"], "a a a a a a a a": ["a a a a a a"], "": []}


def find_plainly(query, library):
    """Every rule of recall, gates and top three, sentence by sentence."""
    import math

    df, n = {}, len({d for d, _, _ in library})
    sh = {(d, i): {" ".join(w[k : k + 6]) for k in range(len(w) - 5)} for d, i, t in library for w in [t.split()]}
    for s, docs in {s: {d for (d, _), v in sh.items() if s in v} for v in sh.values() for s in v}.items():
        df[s] = len(docs)
    out = []
    for q, text in query:
        w = text.split()
        a = {" ".join(w[k : k + 6]) for k in range(len(w) - 5)}
        hits = sorted(((-len(a & b), d, i) for (d, i), b in sh.items() if a & b))[:200]
        seen, kept = set(), []
        weight = {s: math.log(1 + n / max(1, df.get(s, 1))) for s in a}
        for h, d, i in hits:
            b = sh[d, i]
            cov = math.floor(sum(weight[s] for s in a & b) / sum(weight.values()) * 1e9 + 0.5) / 1e9
            sim = math.floor(min(-h / min(len(a), len(b)), 0.5 + 0.5 * cov) * 1e4 + 0.5) / 1e4
            if d not in seen and len(kept) < 3 and cov >= 0.2 and sim >= 0.25:
                seen.add(d)
                kept.append((d, i, sim))
        out += [(q, k + 1, *x) for k, x in enumerate(sorted(kept, key=lambda x: -x[2]))]
    return out


def test_find_similar(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(12)]
    mutate = lambda t: " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in t.split())
    library = [(d, i, mutate(rng.choice(base))) for d in range(25) for i in range(3)]
    query = [(k, mutate(rng.choice(base))) for k in range(30)]
    sents = spark.createDataFrame([(d, i, "en", t, len(t.split())) for d, i, t in library], "doc_id bigint, idx int, kind string, norm string, units int")
    asked = spark.createDataFrame([(k, 0, "en", t, len(t.split())) for k, t in query], "doc_id bigint, idx int, kind string, norm string, units int")
    docs = sents.select("doc_id").distinct()
    got = similarity.find_similar(asked, sents, docs)
    assert sorted(tuple(r) for r in got.select("paper_id", "place", "doc_id", "sent_idx", "sim").collect()) == sorted(find_plainly(query, library))
    assert similarity.find_similar(asked, sents.where("false"), docs.where("false")).count() == 0


def test_overlap_in_small_blocks_with_templates(spark, tmp_path, monkeypatch):
    """Whatever is cut, the best documents are those of a plain walk: blocks, portions of pairs, template shingles, documents across blocks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    from scriven.operators import overlap

    rng = random.Random(5)
    words, frame = [f"w{k}" for k in range(40)], [f"f{k}" for k in range(12)]
    line = lambda: " ".join([*frame[: rng.choice((0, 7, 9, 12))], *(rng.choice(words) for _ in range(rng.randint(0, 9)))])
    base = [line() for _ in range(60)]
    library = [(d, i, rng.choice(base) if rng.random() < 0.5 else line()) for d in range(90) for i in range(5)]
    query = [(k, rng.choice(base) if rng.random() < 0.5 else line()) for k in range(60)]
    query = list({t: (k, t) for k, t in query if len(t.split()) >= 6}.values())
    batch = lambda rows: overlap.digests([t for *_, t in rows], ["en"] * len(rows), np.array([len(t.split()) for *_, t in rows]))
    d, sizes = batch(library)
    each = np.split(d, np.cumsum(sizes)[:-1])
    held = pa.table({"doc_id": pa.array([x for x, _, _ in library], pa.int64()), "idx": pa.array([i for _, i, _ in library], pa.int32()), "shingles": pa.array([x.tobytes() for x in each], pa.binary())})
    pq.write_table(held, tmp_path / "part-0.parquet")
    asked, n = batch(query)
    want = sorted(find_plainly(query, [(d, i, t) for d, i, t in library]))
    for least, share, sentences, hits in ((500, 0.002, 20_000, 10**6), (3, 0.0, 7, 50), (20, 0.0, 33, 1)):
        for name, value in (("LEAST", least), ("SHARE", share), ("SENTENCES", sentences), ("HITS", hits)):
            monkeypatch.setattr(overlap, name, value)
        got = overlap._Queries(np.array([k for k, _ in query]), np.zeros(len(query), bool), asked, n, 90).best(str(tmp_path))
        assert sorted(tuple(r.values()) for r in got.to_pylist()) == want and want


def test_similarities_are_counted_without_pairs(spark, tmp_path, monkeypatch):
    """Counts of blended similarities are those of the table of pairs, whatever is cut and whichever shingles are a template's; the query has no such table."""
    from scriven.operators import overlap
    from scriven.plans import queries

    rng = random.Random(6)
    words, frame = [f"w{k}" for k in range(30)], [f"f{k}" for k in range(12)]
    line = lambda: " ".join([*frame[: rng.choice((0, 7, 9, 12))], *(rng.choice(words) for _ in range(rng.randint(0, 9)))])
    base = [line() for _ in range(50)]
    text = lambda: " ".join((rng.choice(base) if rng.random() < 0.5 else line()) + "." for _ in range(6))
    docs = spark.createDataFrame([(k, text()) for k in range(40)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(k, text()) for k in range(12)], "doc_id bigint, text string")
    library, query = index.library_sentences(index.sentences(docs)), index.sentences(asked)
    blend = T.rounded(F.least("containment", 0.5 + 0.5 * F.col("coverage")), 4)
    want = {tuple(r) for r in similarity.candidates(query, library, docs).groupBy(blend.alias("sim")).agg(F.count("*").alias("pairs")).collect()}
    assert want and {tuple(r) for r in overlap.similarities(query, library, docs).collect()} == want
    # the same in one process, where blocks and portions are small
    told = overlap.with_digests(library).withColumn("cid", index.norm_id(F.col("kind"), F.col("norm")))
    told.coalesce(1).write.parquet(str(tmp_path / "told"))
    (batch,) = overlap._classes(query).coalesce(1).toArrow().combine_chunks().to_batches()
    for least, sentences, hits in ((3, 7, 50), (20, 33, 1)):
        for name, value in (("LEAST", least), ("SHARE", 0.0), ("SENTENCES", sentences), ("HITS", hits)):
            monkeypatch.setattr(overlap, name, value)
        (block,) = overlap._held([batch])
        q = overlap._Queries(*block, 40)
        pairs = q.counts(str(tmp_path / "told"), overlap._leads(str(tmp_path / "told")))
        assert len(q.heavy) and {(k / 10**4, n) for k, n in enumerate(pairs.tolist()) if n} == want
    monkeypatch.setattr(similarity, "candidates", None)
    assert queries.queries()["blended_similarity"](spark, "/root/testdata/sf0.001").count()


def test_recall_lists_pairs_where_they_arise(spark, tmp_path, monkeypatch):
    """The rows are those of the table of pairs, whatever is cut; the query has no such table."""
    from scriven.operators import overlap
    from scriven.plans import queries

    rng = random.Random(9)
    words, frame = [f"w{k}" for k in range(30)], [f"f{k}" for k in range(9)]
    line = lambda: " ".join([*frame[: rng.choice((0, 7, 9))], *(rng.choice(words) for _ in range(rng.randint(2, 9)))])
    base = [line() for _ in range(40)]
    text = lambda: " ".join((rng.choice(base) if rng.random() < 0.5 else line()) + "." for _ in range(6))
    docs = spark.createDataFrame([(k, text()) for k in range(30)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(k, text()) for k in range(10)], "doc_id bigint, text string")
    library, query = index.library_sentences(index.sentences(docs)), index.sentences(asked)
    norms = lambda s, n, m: s.select(index.norm_id(F.col("kind"), F.col("norm")).alias(n), F.col("norm").alias(m)).distinct()
    pairs = similarity.candidates(query, library, docs).join(norms(query, "qid", "query"), "qid").join(norms(library, "cid", "candidate"), "cid")
    rows = lambda df: sorted(tuple(r) for r in df.select("query", "candidate", "hits", "containment", "coverage").collect())
    want = rows(pairs.withColumn("containment", T.rounded(F.col("containment"), 6)).withColumn("coverage", T.rounded(F.col("coverage"), 6)))
    assert len(want) > 300 and rows(overlap.listed(query, library, docs)) == want
    told = overlap.with_digests(library).withColumn("cid", index.norm_id(F.col("kind"), F.col("norm")))
    told.coalesce(1).write.parquet(str(tmp_path / "told"))
    (batch,) = overlap._classes(query).coalesce(1).toArrow().combine_chunks().to_batches()
    for name, value in (("SENTENCES", 33), ("HITS", 20), ("LISTED", 3)):
        monkeypatch.setattr(overlap, name, value)
    ((*block, norm),) = overlap._held([batch], norms=True)
    got = [b for b in overlap._Queries(*block, 30).pairs(str(tmp_path / "told"), overlap._leads(str(tmp_path / "told")), norm)]
    assert sorted(tuple(r.values()) for b in got for r in b.to_pylist()) == want
    monkeypatch.setattr(similarity, "candidates", None)
    assert queries.queries()["recall_candidates"](spark, "/root/testdata/sf0.001").count()


def test_check_writes_the_library_once(spark, monkeypatch):
    """Sentences and digests of a library are one stored table without texts, and the checks that rewriting makes share it."""
    from scriven.operators import overlap
    from scriven.plans.check import Check

    text = "This study shows significant results and numerous individuals use new methods to obtain the quality of research every year. "
    docs = spark.createDataFrame([(1, "t", text * 2, 0), (2, "u", text + "Filler words make this document longer than others are. ", 0)], "doc_id bigint, title string, text string, is_builtin int")
    c = Check(docs, spark.createDataFrame([("p", text)], "doc_id string, text string"))
    monkeypatch.setattr(overlap, "digested", None)  # the shuffle by document
    assert [r.matched_sentences for r in c.rates.collect()] == [1]
    assert c.digested.columns == ["doc_id", "idx", "kind", "norm", "units", "shingles"]
    assert c.library_sentences.inputFiles() == c.digested.inputFiles() and "text" not in c.library_sentences.columns
    assert c.unstripped.digested is c.digested
    assert [r.changed for r in c.rewrite_delta("dedup").collect()] == [1]


def test_fragments_and_rates(spark):
    """Matched 1 0 1 is one fragment, 1 0 0 1 two; citations count apart."""
    pattern = "1011001" + "0"
    rows = [(1, k, 10 * k, 10 * k + 10, f"s{k}|", 10, int(m) * 7 or None, 0.5 if m == "1" else None, m == "1", 9 if k == 6 else 2) for k, m in enumerate(pattern)]
    df = spark.createDataFrame(rows, "doc_id bigint, idx int, start_pos int, end_pos int, text string, units int, source_id bigint, sim double, matched boolean, quote_units int")
    got = sorted((r.start_pos, r.end_pos, r.text, r.dup_units) for r in report.fragments(df).collect())
    assert got == [(0, 40, "s0|s1|s2|s3|", 30), (60, 70, "s6|", 10)]
    (rate,) = report.rates(df).collect()
    assert (rate.total_units, rate.dup_units, rate.quote_units, rate.matched_sentences) == (80, 30, 10 + 7 * 2, 4)
    assert report.fragments(df.where("false")).count() == 0 == report.rates(df.where("false")).count()


def test_fragments_are_summed_once(spark):
    """Sources and spans of fragments come from one aggregation: three joins, for texts, spans and totals."""
    df = spark.createDataFrame([], "doc_id bigint, idx int, start_pos int, end_pos int, text string, units int, source_id bigint, sim double, matched boolean, quote_units int")
    plan = report.fragments(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join Inner") == 3


def test_strip_references_and_html(spark):
    df = spark.createDataFrame([("body\nReferences\n[1] x",), ("a References b",), ("x\n参 考 文 献\ny\nReferences\nz",), (None,)], "t string")
    assert [r[0] for r in df.select(T.strip_references(F.col("t"))).collect()] == ["body\n", "a References b", "x\n参 考 文 献\ny\n", None]
    page = "<html><head><title>no</title></head><body><script>x<1</script>A &amp;lt; <b>B</b>&copy;<style>s</style>\n C</body>"
    (r,) = spark.createDataFrame([(page,)], "t string").select(T.html_text(F.col("t"))).collect()
    assert r[0] == "A &lt; B © C"


def test_rewriting(spark):
    df = spark.createDataFrame([("en", "We investigate and EXAMINE moreover."), ("zh", "此外，研究表明随着应用。"), ("en", None)], "kind string, t string")
    got = [tuple(r) for r in df.select(rewrite.swap_synonyms(F.col("t"), F.col("kind")), rewrite.swap_cliches(F.col("t"), F.col("kind"))).collect()]
    assert got == [("We examine and look at moreover.", "We investigate and EXAMINE also."), ("另外，已有研究显示伴随运用。", "此外，研究表明随着应用。"), (None, None)]
    long = "一二三四五六七八九十" * 2 + "，" + "一二三四五六七八九十" * 2 + "，末。"
    (r,) = spark.createDataFrame([(long,)], "t string").select(rewrite.split_long(F.col("t"), F.lit("zh"))).collect()
    assert r[0] == long[:20] + "。" + long[21:]
    sents = spark.createDataFrame([(1, k, "此外，甲") for k in range(3)], "doc_id bigint, idx int, text string")
    assert [r.thinned for r in rewrite.thin_connectors(sents).orderBy("idx").collect()] == ["此外，甲", "甲", "甲"]
    docs = spark.createDataFrame([(1, "abcdef"), (2, "same"), (3, None)], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, 0, 2, "X"), (1, 3, 5, "YY")], "doc_id bigint, start_pos int, end_pos int, new string")
    assert sorted((r.doc_id, r.text) for r in rewrite.full_text(docs, edits).collect()) == [(1, "XcYYf"), (2, "same"), (3, None)]


def test_chunks(spark):
    df = spark.createDataFrame([(1, k, u) for k, u in enumerate([200, 180, 1, 500, 3])], "doc_id bigint, idx int, units int")
    assert [(r.chunk, r.units) for r in chunks.pack(df).orderBy("chunk").collect()] == [(0, 380), (1, 1), (2, 500), (3, 3)]
    p = spark.createDataFrame([([("Human", 0.9), ("LABEL_1", 0.4), ("AI", 0.6)],), ([],)], "p array<struct<label: string, score: double>>")
    assert [r[0] for r in p.select(chunks.machine_probability(F.col("p"))).collect()] == [0.6, 0.0]


def test_auroc_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 1), float(rng.randint(0, 5))) for _ in range(80)] + [("c", 1, 3.0)]
    got = {r.lang: r.auroc for r in evaluate.auroc(spark.createDataFrame(rows, "lang string, label int, score double"), "lang").collect()}
    for lang in "ab":
        pos = [s for x, y, s in rows if x == lang and y]
        neg = [s for x, y, s in rows if x == lang and not y]
        assert got[lang] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg), abs=1e-6)
    assert got["c"] is None


def test_records(spark):
    library = spark.createDataFrame([(1, "x" * 200 + "tail", 1), (2, "kept", 0)], "doc_id bigint, title string, is_builtin int")
    incoming = spark.createDataFrame([(7, "x" * 200 + "other"), (8, "new"), (9, "new"), (10, None), (11, "")], "doc_id bigint, title string")
    assert [r.doc_id for r in records.ingest(incoming, library).collect()] == [8]
    gone = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    assert [r.doc_id for r in records.delete_user_documents(library, gone).collect()] == [1]
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, v int, t string")
    new = spark.createDataFrame([(1, 5, "c"), (2, 4, "d"), (3, None, "e")], "k int, v int, t string")
    assert sorted((r.k, r.t) for r in records.upsert(old, new, ["k"], "v").collect()) == [(1, "c"), (2, "b"), (3, "e")]


def test_web_matches(spark):
    pages = spark.createDataFrame([(1, "Intro here. the quick brown fox jumps over a lazy dog today again. End"), (2, "other words only")], "doc_id bigint, text string")
    norm = "the quick brown fox jumps over a lazy dog today again"
    found = spark.createDataFrame([("p", 0, "en", norm, 11), ("p", 1, "en", "quick brown fox jumps over a lazy cat or two", 10)], "doc_id string, idx int, kind string, norm string, units int")
    got = {r.idx: (r.page_id, r.sim) for r in web.web_matches(found, pages).collect()}
    assert got[0] == (1, 1.0) and got[1][0] == 1 and got[1][1] == pytest.approx(0.4, abs=1e-4)


def test_best_pages_equal_web_matches(spark, monkeypatch):
    """The best page of each candidate is that of ``web_matches``, whatever is cut and whichever shingles are a template's; web_verify lists no pairs."""
    import numpy as np
    from scriven.operators import overlap
    from scriven.plans import queries
    from scriven.session import stored

    rng = random.Random(5)
    words, frame, signs = [f"w{k}" for k in range(25)], [f"f{k}" for k in range(14)], "天地玄黄宇宙洪荒日月盈昃"
    en = lambda: " ".join([*frame[: rng.choice((0, 8, 14))], *(rng.choice(words) for _ in range(rng.randint(3, 9)))])
    zh = lambda: "".join(rng.choice(signs) for _ in range(3)) * rng.randint(4, 6) + "辰宿列张寒来暑往"[: rng.choice((0, 4, 8))]
    base = [rng.choice((en, zh))() for _ in range(60)]
    pages = [(k, ". ".join((rng.choice(base) if rng.random() < 0.6 else rng.choice((en, zh))()) for _ in range(8)) + ".") for k in range(60)]
    texts = [*base, *(zh() for _ in range(10)), *(en() for _ in range(20)), *(b[1:-1] for b in base[:20])]
    rows = [("p", k, "zh" if t[0] > "z" else "en", t, len(t) if t[0] > "z" else len(t.split(" "))) for k, t in enumerate(texts)]
    asked = spark.createDataFrame([r for r in rows if r[4] >= (12 if r[2] == "zh" else 8)], "doc_id string, idx int, kind string, norm string, units int")
    pages = spark.createDataFrame(pages, "doc_id bigint, text string")
    want = {}
    for r in web.web_matches(asked, pages).collect():
        want[r.idx] = max(want.get(r.idx, (0, 0)), (r.sim, -r.page_id))
    assert len(want) > 40 and len({s for s, _ in want.values()}) > 3
    got = lambda: {r.idx: (r.sim, -r.page_id) for r in web.best_pages(asked, pages).collect()}
    assert got() == want
    cut = asked.select(index.norm_id(F.col("kind"), F.col("norm")).alias("qid"), "idx", "kind", "norm", "units")
    (b,) = cut.coalesce(1).toArrow().combine_chunks().to_batches()
    sents = index.sentences(pages).where("units >= 6").coalesce(1).toArrow()
    near = {r.qid: (r.sim, r.page_id) for r in overlap.nearest_pages(stored(cut), index.sentences(pages).where("units >= 6")).groupBy("qid").agg(F.max("sim").alias("sim"), F.min_by("page_id", F.struct(-F.col("sim"), "page_id")).alias("page_id")).collect()}
    for least, hits in ((5, 50), (40, 1)):
        monkeypatch.setattr(overlap, "LEAST", least)
        monkeypatch.setattr(overlap, "SHARE", 0.0)
        monkeypatch.setattr(overlap, "HITS", hits)
        d, sizes = overlap.digests(sents["norm"].to_pylist(), sents["kind"].to_pylist(), sents["units"].to_numpy())
        ends = np.cumsum(sizes)
        blocks = [(sents["doc_id"].to_numpy()[k : k + 37], np.arange(len(sizes[k : k + 37])), d[ends[k] - sizes[k] : ends[min(k + 37, len(sizes)) - 1]], sizes[k : k + 37]) for k in range(0, len(sizes), 37)]
        (block,) = overlap._held([b], 4)
        q = overlap._Queries(*block, 1)
        best, page = q.nearest(blocks)
        assert len(q.heavy) and {i: (s / 10**4, p) for i, s, p in zip(q.ids.tolist(), best.tolist(), page.tolist(), strict=True) if s >= 0} == near
    monkeypatch.undo()
    monkeypatch.setattr(web, "web_matches", None)
    queries.queries()["web_verify"](spark, "/root/testdata/sf0.001").count()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("中文".encode("gb18030"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"broken")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("héllo", None) and got["b.md"] == ("中文", None) and got["d.docx"] == ("one\ntwo", None)
    assert got["c.exe"] == (None, "unsupported format") and got["e.docx"][0] is None and got["e.docx"][1]


def test_harvest(spark):
    words = " ".join(f"w{k}" for k in range(40))
    places = ", ".join(f'"w{k}": [{k}]' for k in range(40))
    work = '{"id": "u", "title": " A  b ", "abstract_inverted_index": {' + places + "}}"
    assert [tuple(r) for r in harvest.openalex(spark.createDataFrame([(work,), ("{}",), (None,)], "json string")).collect()] == [("A b", words, "u")]
    feed = f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>T\n t</title><summary>{words}</summary></entry><entry><id>j</id><title>x</title><summary>short</summary></entry></feed>'
    assert [tuple(r) for r in harvest.arxiv(spark.createDataFrame([(feed,)], "xml string")).collect()] == [("T t", words, "i")]
    article = '{"bibjson": {"title": "D", "abstract": "' + words + '", "link": [{"type": "x", "url": "no"}, {"type": "fulltext", "url": "yes"}]}}'
    assert [tuple(r) for r in harvest.doaj(spark.createDataFrame([(article,)], "json string")).collect()] == [("D", words, "yes")]
    result = '{"id": "1", "source": "MED", "title": "<i>E</i>", "abstractText": "' + words + '"}'
    assert [tuple(r) for r in harvest.europepmc(spark.createDataFrame([(result,)], "json string")).collect()] == [("E", words, "https://europepmc.org/article/MED/1")]
    assert harvest.clamp_target("arxiv", 5) == 20 and harvest.clamp_target("doaj", 10**6) == 10_000


def test_limiter():
    ok, log = stateful.admit([0, 1, 2, 3, 61, 62.5], [], 3, 60)
    assert ok == [True, True, True, False, True, True] and log == [61, 62.5]


def test_limiter_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts")
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = stateful.limiter_stream(stream, 3, 86_400).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(60)
    got = {(r.event_id, r.admitted) for r in spark.table("limited").collect()}
    assert got == {(r.event_id, r.admitted) for r in stateful.limiter(events, 3, 86_400).collect()} and len(got) == events.count()


def test_bans(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    kinds = ["error"] * 4 + ["signup"] + ["error"] * 5 + ["signup", "view"]
    rows = [(1, k, start + timedelta(seconds=10 * k), e) for k, e in enumerate(kinds)] + [(1, 99, start + timedelta(seconds=2000), "error"), (2, 50, start, "error")]
    got = {r.event_id: r.state for r in stateful.bans(spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp, event_type string")).collect()}
    assert got[4] == "ok" and got[9] == "failed" and got[10] == got[11] == "banned" and got[99] == got[50] == "failed"


def test_bans_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts", "event_type").where("user_id IS NOT NULL")
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = stateful.bans_stream(stream).writeStream.format("memory").queryName("banned").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(60)
    got = {(r.event_id, r.state) for r in spark.table("banned").collect()}
    assert got == {(r.event_id, r.state) for r in stateful.bans(events).collect()} and len(got) == events.count()


def test_a_clients_history_is_folded_in_parts(spark, monkeypatch):
    """Parted where the client was silent, the outcome is that of one fold over everything."""
    from datetime import datetime, timedelta

    monkeypatch.setattr(stateful, "FOLD_ROWS", 5)
    rng, at, rows = random.Random(3), datetime(2024, 1, 1), []
    for k in range(200):
        at += timedelta(seconds=rng.choice([1, 5, 20, 70]))
        rows.append((1, k, at))
    got = {r.event_id: r.admitted for r in stateful.limiter(spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp"), 3, 60).collect()}
    want, _ = stateful.admit([t.timestamp() for _, _, t in rows], [], 3, 60)
    assert [got[k] for k in range(200)] == want


def test_html_text(spark):
    cases = {
        "<p>a<svg><g>x<svg>y</svg>z</g></svg>b</p>": "a b",
        "<head><title>t</title></head><body>one<!-- two --><br>three &amp;lt; &#8364;&#x4e2d;</body>": "one three &lt; €中",
        "<script>if (a < b) x()</script>kept<SCRIPT>never closed": "kept",
        "<noscript>hidden": "",
        "a < b &nbsp; c": "a < b c",
        "</svg>shown": "shown",
        "": "",
    }
    df = spark.createDataFrame([(h,) for h in cases] + [(None,)], "html string").withColumn("t", T.html_text(F.col("html")))
    assert {r.html: r.t for r in df.collect()} == cases | {None: None}
    assert spark.sql("SELECT ' <b>x &lt;</b> &#1;&#xD800;y ' AS t").select(T.strip_tags(F.col("t")).alias("t")).first().t == "x < \x01\ufffdy"


def test_params_key_is_the_digest_of_sorted_json(spark):
    import hashlib
    import json

    rows = [{"mode": "aigc", "strip_references": False, "web_check": True, "web_check_count": 5}, {}, {"web_check": True, "other": 1}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "k int, o string")
    full = {"mode": "full", "strip_references": True, "web_check": False, "web_check_count": 10}
    want = [hashlib.sha256(json.dumps(full | {k: v for k, v in r.items() if k in full}, sort_keys=True).encode()).hexdigest() for r in rows]
    assert [r.h for r in df.select("k", records.params_key(F.col("o")).alias("h")).orderBy("k").collect()] == want


def test_harvest_ends_with_the_target_or_too_many_known_titles(spark):
    docs = [("a", k, f"t{k}") for k in range(30)] + [("b", 100 + k, "same") for k in range(30)] + [("c", 200, None), ("c", 201, " ")]
    df = spark.createDataFrame(docs, "source string, doc_id bigint, title string")
    library = spark.createDataFrame([("t0",), ("t1",)], "title string")
    got = {r.source: (r.fetched, r.added) for r in records.harvest(df, library, 25, 5).collect()}
    assert got == {"a": (25, 23), "b": (7, 1)}
    assert records.harvest(df.where("false"), library, 25).count() == 0


def test_seeds_fill_an_empty_library_only(spark, tmp_path):
    (tmp_path / "zh.json").write_text('[{"title": "A", "content": "x"}, {"title": "B", "content": ""}]', encoding="utf-8")
    library = spark.createDataFrame([("t",)], "title string")
    got = [tuple(r) for r in harvest.seeds(spark, str(tmp_path / "*.json"), library.where("false")).collect()]
    assert got == [("A", "x", 1, "zh.json")] and harvest.seeds(spark, str(tmp_path / "*.json"), library).count() == 0
    jobs = spark.createDataFrame([("arxiv", 5), ("doaj", 10**6), ("x", 7)], "source string, target_count int")
    assert {r.source: r.target for r in harvest.clamped(jobs, harvest.sources(spark)).collect()} == {"arxiv": 20, "doaj": 10_000, "x": None}


def test_engine_outcomes(spark):
    from scriven.operators import engines

    local = spark.createDataFrame([("a", 40.0), ("b", 50.0)], "doc_id string, total_rate double")
    model = spark.createDataFrame([("a", 0.25), ("b", None)], "doc_id string, probability double")
    called = spark.createDataFrame([("a", "external-en", 0.5)], "doc_id string, engine string, probability double")
    got = {(r.doc_id, r.engine): (r.status, r.rate) for r in engines.outcomes(local, model, called, ("external-en",)).collect()}
    assert got["a", "local"] == ("ok", 40.0) and got["a", "transformers"] == ("ok", 25.0) and got["b", "transformers"] == ("error", None)
    assert got["a", "external-en"] == ("ok", 50.0) and got["b", "external-en"] == ("error", None) and got["a", "external-zh"] == ("not_configured", None)
    assert got["a", "watermark"][0] == "experimental" and len(got) == 2 * len(engines.REGISTRY)
    assert {r.status for r in engines.outcomes(local).where("engine = 'transformers'").collect()} == {"not_configured"}


def test_simhash_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(60):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 14)):
            p ^= 1 << b
        prints.append(p)
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "doc_id bigint, fingerprint bigint")
    first = {}
    for k, p in enumerate(prints):
        first.setdefault(p, k)
    want = {(a, b, (p ^ q).bit_count()) for p, a in first.items() for q, b in first.items() if a < b and (p ^ q).bit_count() <= 12}
    assert {tuple(r) for r in index.simhash_pairs(df).collect()} == want and want
    assert all(r.class_id == first[prints[r.doc_id]] for r in index.simhash_classes(df).collect())
    assert index.simhash_pairs(df.where("false")).count() == 0


def test_simhash_pairs_write_no_lookups(spark):
    """Lookups of fingerprints are not rows: the plan of the pairs neither explodes nor exchanges anything."""
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 5), (4, -1)], "doc_id bigint, fingerprint bigint")
    pairs = index.simhash_pairs(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 1)]


def test_snapshot_is_read_until_the_collection_changes(spark, tmp_path):
    import os

    from scriven.operators import lm, snapshot
    from scriven.plans.check import Check

    text = "The quick brown fox jumps over the lazy dog near the river bank today. Another plain sentence follows this one here. "
    docs = spark.createDataFrame([(k, f"t{k}", text * (k + 1), 0) for k in range(4)], "doc_id bigint, title string, text string, is_builtin int")
    root = str(tmp_path / "index")
    tables = snapshot.snapshot(docs, root)
    (state,) = os.listdir(root)
    made = os.path.getmtime(f"{root}/{state}")
    again = snapshot.snapshot(docs.orderBy(F.desc("doc_id")), root)
    assert os.listdir(root) == [state] and os.path.getmtime(f"{root}/{state}") == made
    plain = index.library_sentences(index.sentences(docs))
    assert sorted(map(tuple, again["sentences"].collect())) == sorted(map(tuple, plain.collect()))
    assert {tuple(r) for r in again["size"].collect()} == {tuple(r) for r in lm.Model(plain).size.collect()}
    papers = spark.createDataFrame([("p", text + "Something that is nowhere else is written in this very line. ")], "doc_id string, text string")
    both = [{tuple(r) for r in Check(docs, papers, tables=t).rates.collect()} for t in (tables, None)]
    assert both[0] == both[1]
    snapshot.snapshot(docs.where("doc_id > 0"), root)
    assert len(os.listdir(root)) == 1 and os.listdir(root) != [state]


def test_rewriting_measures_reference_sections_alike(spark):
    """A sentence of a reference section is rewritten too, and unchanged texts have equal rates before and after."""
    import json

    from scriven.plans.check import Check

    copied = "This study shows significant results and numerous individuals use new methods to obtain the quality of research every year. "
    docs = spark.createDataFrame([(1, "t", copied * 2 + "Filler words make this document longer than others are. " * 3, 0)], "doc_id bigint, title string, text string, is_builtin int")
    rows = [("with", "Some opening line that nobody wrote before.\nReferences\n" + copied), ("plain", "Nothing here was written anywhere else at all before now.")]
    c = Check(docs, spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.doc_id: r.dup_units for r in c.rates.collect()}["with"] == 0
    changed = {r.doc_id: r for r in c.edits("dedup").collect()}
    assert set(changed) == {"with"} and "synonym" in changed["with"].reasons
    delta = {r.doc_id: r for r in c.rewrite_delta("dedup").collect()}
    assert delta["with"].dup_before > 0 and delta["with"].dup_after <= delta["with"].dup_before and delta["with"].machine_before is None
    assert delta["plain"].changed == 0 and delta["plain"].dup_before == delta["plain"].dup_after
    assert {r.doc_id: r.machine_after for r in c.rewrite_delta("humanize").collect()}["plain"] is not None
    for mode, parts in (("full", (True, True)), ("plagiarism", (True, False)), ("aigc", (False, True))):
        report_ = {r.doc_id: json.loads(r.report) for r in c.full_report(mode).collect()}["plain"]
        assert ("plagiarism" in report_, "aigc" in report_) == parts and report_["options"]["mode"] == mode
    html = {r.doc_id: r.html for r in c.html_report().collect()}
    assert "Nothing here was written" in html["plain"] and "<td>manual</td>" in html["plain"]


def test_listed_pairs_of_a_candidate_follow_each_other(spark, tmp_path):
    """Written in runs, the candidates' texts take few bytes of the result."""
    from scriven.operators import overlap

    rng = random.Random(5)
    line = lambda: " ".join(["these words stand in every line", *(f"w{rng.randint(0, 50)}" for _ in range(6))]) + "."
    docs = spark.createDataFrame([(k, " ".join(line() for _ in range(4))) for k in range(20)], "doc_id bigint, text string")
    library = index.library_sentences(index.sentences(docs))
    told = overlap.with_digests(library).withColumn("cid", index.norm_id(F.col("kind"), F.col("norm")))
    told.coalesce(1).write.parquet(str(tmp_path / "told"))
    (batch,) = overlap._classes(library).coalesce(1).toArrow().combine_chunks().to_batches()
    ((*block, norm),) = overlap._held([batch], norms=True)
    found = [x for b in overlap._Queries(*block, 20).pairs(str(tmp_path / "told"), overlap._leads(str(tmp_path / "told")), norm) for x in b["candidate"].to_pylist()]
    runs = 1 + sum(a != b for a, b in zip(found, found[1:], strict=False))
    assert len(found) > 20 * runs and runs == len(set(found))


def test_rewriting_is_measured_in_one_mode_after_another(spark):
    """Tables of one mode go with it; those that the next mode reads too, also after digests have gone, stay."""
    from scriven.operators import rewrite
    from scriven.plans.check import Check

    copied = "This study shows significant results and numerous individuals use new methods to obtain the quality of research every year. "
    docs = spark.createDataFrame([(1, "t", copied * 2 + "Filler words make this document longer than others are. " * 3, 0)], "doc_id bigint, title string, text string, is_builtin int")
    rows = [("with", "Some opening line that nobody wrote before.\nReferences\n" + copied), ("plain", "Nothing here was written anywhere else at all before now.")]
    papers = spark.createDataFrame(rows, "doc_id string, text string")
    plain = Check(docs, papers, strip=False)
    dup, machine = ({r.doc_id: r.total_rate for r in t.collect()} for t in (plain.rates, plain.machine_rates))
    c = Check(docs, papers)
    c.again = False
    c.edits().collect()
    found = [c.rewrite_delta(mode) for mode in rewrite.MODES]
    for mode, delta in zip(rewrite.MODES, found, strict=True):
        rows = {r.doc_id: r for r in delta.collect()}
        assert {k: r.dup_before for k, r in rows.items()} == (dict.fromkeys(dup) if mode == "humanize" else dup)
        assert {k: r.machine_before for k, r in rows.items()} == (dict.fromkeys(machine) if mode == "dedup" else machine)
        assert all((r.dup_after is None) == (mode == "humanize") and (r.machine_after is None) == (mode == "dedup") for r in rows.values())


def _sql_names():
    """Queries to compare: those that are a step or a sum of another one of the list are left to the driver, for time."""
    from scriven.plans import oracle

    steps = (
        "aigc_doc_score aigc_features aigc_paragraphs best_f1 blended_similarity corpus_stats detect_language eval_by_lang eval_scores f1_sweep "
        "highlight_class incremental_index index_remove library_listing library_parts library_scan lm_counts lm_doc_burst machine_bands normalize_text "
        "aigc_sentence_scores engine_outcomes eval_gates lm_sentence_stats source_variants point_lookup quoted_units recall_candidates rewrite_cliches rewrite_synonyms sentence_units source_counts source_totals web_candidates web_query word_count"
    )
    return sorted(set(oracle.oracle_sql()) - set(steps.split()))


@pytest.fixture(scope="module")
def small():
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", _sql_names())
def test_oracle(spark, small, name):
    from scriven.plans import oracle, queries

    got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = small.execute(oracle.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    form = lambda d: sorted(tuple("" if v is None or isinstance(v, float) and v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert form(got) == form(want)


def test_every_oracle_has_a_query():
    from scriven.plans import oracle, queries

    assert set(oracle.oracle_sql()) <= set(queries.queries())


def _library_and_papers(spark):
    text = "This study shows significant results and numerous individuals use new methods to obtain the quality of research every year. "
    own = "Rivers carry sand toward the open sea while winter storms slowly move it along the coast again. "
    docs = spark.createDataFrame([(1, "t", text * 8, True), (2, "u", own * 9, False)], "doc_id bigint, title string, text string, is_builtin boolean")
    return docs, spark.createDataFrame([(7, text + own * 2 + text)], "doc_id bigint, text string")


def test_report_parts_are_made_one_by_one(spark):
    """What a report and its page are put together of is stored: neither plan reads sentences any more."""
    from scriven.plans.check import Check

    text = "This study shows significant results and numerous individuals use new methods to obtain the quality of research every year. "
    docs = spark.createDataFrame([(1, "t", text * 2, 0)], "doc_id bigint, title string, text string, is_builtin int")
    for make in (Check.full_report, Check.html_report):
        c = Check(docs, spark.createDataFrame([("p", text * 2)], "doc_id string, text string"))
        out = make(c)
        assert c.sentences.inputFiles() and not {*out.inputFiles()} & {*c.sentences.inputFiles(), *c.sentence_scores.inputFiles(), *c.matches.inputFiles()}
        assert text[:40] in out.first()[1]


def test_digests_go_when_matches_are_there(spark):
    from pathlib import Path

    from scriven.operators import overlap
    from scriven.plans.check import Check

    c = Check(*_library_and_papers(spark))
    c.again = False
    folder = overlap.folder_of(c.digested).removeprefix("file:")
    assert c.matches.count() and Path(folder).exists()
    assert c.sentence_scores.count()
    assert not Path(folder).exists() and "digested" not in c.__dict__
    assert c.results.where("matched").count()


def test_model_counts_equal_sql(spark):
    from scriven.operators import lm

    rows = [(1, 0, "en", "one two three a b c d e f g " * 20 + "end"), (1, 1, "zh", "研究a表明" * 3), (2, 0, "zh", "人工智能技术a正在改变人类社会的方方面面" * 12), (2, 1, "en", "b c a one two"), (3, 0, "en", "too short")]
    library = spark.createDataFrame([(d, i, k, n * (40 if d == 2 and i == 0 else 1)) for d, i, k, n in rows], "doc_id bigint, idx int, kind string, norm string")
    asked = [("en", "one two three a b c d e f g"), ("en", "a a a a a a a a a"), ("zh", "人工智能技术a正在改变"), ("zh", "短"), ("en", "x1 x2 x3 x4 x5 x6 x7 x8"), ("en", "b c d e f g one"), ("zh", "")]
    sents = spark.createDataFrame(asked, "kind string, norm string")
    m = lm.Model(library)
    new = {r.sid: [round(x, 9) for x in r[1:]] for r in m.sentence_stats(sents).collect()}
    m.counts = None
    old = {r.sid: [round(x, 9) for x in r[1:]] for r in m.sentence_stats(sents).collect()}
    assert len(new) == 4 and new == old


def test_rewriting_steps_are_planned_once(spark):
    sents = spark.createDataFrame([(1, 0, 0, 9, "We obtain significant results.", "en")], "doc_id bigint, idx int, start_pos int, end_pos int, text string, kind string")
    scores = spark.createDataFrame([(1, 0, "high")], "doc_id bigint, start_pos int, level string")
    edits = rewrite.rewrite(sents, spark.createDataFrame([(1, 0, True)], "doc_id bigint, start_pos int, matched boolean"), scores)
    assert edits.collect()[0].new == "We get notable results."
    assert edits._jdf.queryExecution().optimizedPlan().toString().count("approximately") == 1
