"""Sentences, languages, look-alike forms, tokens and terms."""

import random
from collections import Counter

import pytest
from scriven.llm import languages, lookalike, queries, sentences, terms, tokens

LONG = "word " * 60_000


def cut(text):
    return [text[a:b] for a, b in sentences.split(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dr. A. Smith saw 3.14 mm, e.g. in Fig. 12 of U.N. papers. Then he left!", ["Dr. A. Smith saw 3.14 mm, e.g. in Fig. 12 of U.N. papers.", "Then he left!"]),
        ("“Is it so? Nobody knows!” wrote Ann in 1998. Next one.", ["“Is it so? Nobody knows!” wrote Ann in 1998.", "Next one."]),
        ("1. Background\nIt ran in\ntwo lines. End", ["1. Background", "It ran in\ntwo lines.", "End"]),
        ("一、背景\n他说：“真的吗？没有人知道。”随后又补充了例子。完了！", ["一、背景", "他说：“真的吗？没有人知道。”随后又补充了例子。", "完了！"]),
        ("值为9 mm……但样本少。彼は「誰も知らない。」と述べた。", ["值为9 mm……但样本少。", "彼は「誰も知らない。」と述べた。"]),
        ("ผลการทดลองรหัสXZ-1แสดงว่าดี งานวิจัยนี้ศึกษา2.5ครั้ง The end.", ["ผลการทดลองรหัสXZ-1แสดงว่าดี", "งานวิจัยนี้ศึกษา2.5ครั้ง", "The end."]),
        ("Am 3. Mai 2022 kam z. B. Abb. 7 dazu. Est-il vrai ? Oui.", ["Am 3. Mai 2022 kam z. B. Abb. 7 dazu.", "Est-il vrai ?", "Oui."]),
        ("Version 2.1.3 of X handles a... but not bits. Code XF-20.In a sample", ["Version 2.1.3 of X handles a... but not bits.", "Code XF-20.", "In a sample"]),
        ("​He w­ent.​  Sh⁠e too.", ["​He w­ent.​", "Sh⁠e too."]),
        ("...", ["..."]),
        ("天很黑" * 30 + "吗然而" + "无人来" * 30, ["天很黑" * 30 + "吗", "然而" + "无人来" * 30]),
        ("他说：“真的吗？”随后没有人来。", ["他说：“真的吗？”随后没有人来。"]),
        ("  \n\t ", []),
    ],
)
def test_sentences(text, expected):
    assert cut(text) == expected


def test_sentences_cover_all_but_blanks():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("aB1 .!?。，“”\"()\n ​ไ中か…") for _ in range(rng.randint(0, 60)))
        got = sentences.split(text)
        kept = {i for a, b in got for i in range(a, b)}
        assert all(i in kept or c.isspace() for i, c in enumerate(text)), repr(text)
        assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_best_path_equals_all_paths():
    """The path through a lattice with long arcs against every choice of gaps."""
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(200):
        places = sorted(rng.sample(range(1, 60), rng.randint(0, 7)))
        gaps = [(p, p, rng.uniform(-7, 3)) for p in places]

        def worth(chosen):
            edges = [0, *(g[1] for g in chosen), 60]
            return sum(g[2] for g in chosen) - sum(sentences.LENGTH_COST * max(0, b - a - 15) for a, b in zip(edges, edges[1:], strict=False))

        best = max(worth(c) for n in range(len(gaps) + 1) for c in combinations(gaps, n))
        assert abs(worth(sentences._best_path(gaps, 0, 60, 15)) - best) < 1e-9


def test_word_lattice_takes_the_fewest_strange_characters():
    def words(run):
        return [run[a:b] for a, b in sentences.lattice_words(run)]

    assert words("他来了然而天黑了") == ["了", "然而", "了"] and words("本研究では") == ["本研究", "で", "は"] and words("abc") == []


def test_unmarked_text(spark):
    """Chinese, Japanese and Thai sentences run together without a mark, cut by words counted in other texts."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/library_docs.parquet").select("id", "content", "lang").distinct()
    fitted = sentences.fit_words(docs.where("id % 2 = 0"), "content")
    without = sentences.fit_words(docs.where("id % 2 = 0"), "content")
    without.final = dict.fromkeys(without.final, 0.0)
    changed = 0
    for lang, recall in (("zh", 0.3), ("ja", 0.4), ("th", 0.6)):
        hit = got = want = 0
        for r in docs.where(f"lang = '{lang}' AND id % 2 = 1 AND content IS NOT NULL").collect():
            parts = [re.sub(r"[^\w]+$", "", lookalike.INVISIBLE.sub("", x)) for x in cut(r.content)]
            parts = [p for p in parts if len(p) > 15 and not re.search(r"[ “「!?。！？…\n]", p)]
            text, ends = "".join(parts), set()
            for p in parts[:-1]:
                ends.add(max(ends, default=0) + len(p))
            found = {a for a, _ in sentences.split(text, fitted)} - {0}
            hit, got, want = hit + len(found & ends), got + len(found), want + len(ends)
            changed += found != {a for a, _ in sentences.split(text, without)} - {0}
        assert hit >= recall * want and hit >= 0.8 * got and want > 20, (lang, hit, got, want)
    assert changed  # the particles carry some of these gaps
    assert sentences.fit_words(docs.where("false"), "content").final == sentences.PLAIN_WORDS.final


def test_sentence_offsets_of_a_table(spark):
    rows = [(1, "Ab bc. Cd.", "x"), (1, "Ab bc. Cd.", "x"), (2, None, "x"), (3, "", "x"), (4, LONG, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, content string, start_pos string")
    got = sorted(map(tuple, sentences.sentence_offsets(df, "doc_id", "content").collect()))
    assert got == [(1, 0, 6), (1, 7, 10), (4, 0, len(LONG) - 1)]
    assert sentences.sentence_offsets(df.where("false"), "doc_id", "content").count() == 0


def test_pieces(spark):
    docs = spark.createDataFrame([(1, "Ab bc. Cd.")], "id bigint, content string")
    pieces = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 10), (1, 2, None, None), (9, 0, 0, 3)], "doc_id bigint, idx int, start_pos int, end_pos int")
    got = sorted(map(tuple, sentences.pieces_in_sentences(docs, pieces).collect()))
    assert got == [(1, 0, 0, 6), (1, 1, 0, 6), (1, 1, 7, 10)]


def test_same_form():
    same = lookalike.same_form
    assert same("ｆｉｌｅ ﬁ") == "file fi"
    assert same("é") == same("é") == same("e​́")
    assert same("сору а­b") == "copy ab"
    assert same("ё") == same("ë") and same("й") != same("и")
    assert same("é") != same("e") and same("A") != same("a") and same("a b") != same("ab") and same("a  b") != same("a b")
    assert same(None) is None and same("") == ""


def test_look_pairs(spark):
    rows = [(1, "café x"), (2, "café x"), (3, "cafe x"), (4, "café x"), (5, "café x"), (6, None), (7, " "), (8, " "), (2, "café x"), (9, "Café x")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "id bigint, content string, key string")
    got = sorted(map(tuple, lookalike.look_pairs(df, "id", "content").collect()))
    assert got == [(1, 2), (1, 4), (2, 4), (2, 5), (4, 5)]
    classes = {r.key: r.class_key for r in lookalike.look_classes(df, "id", "content").collect()}
    assert classes[5] == classes[4] == 1 and classes[3] == 3 and 6 not in classes
    assert lookalike.look_pairs(df.where("false"), "id", "content").count() == 0


def test_look_pairs_of_a_hot_class(spark):
    df = spark.range(400).selectExpr("id", "if(id = 7, 'ａ b', 'a b') AS content")
    assert lookalike.look_pairs(df, "id", "content").count() == 399


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary()


def test_tokens_equal_the_public_library(vocabulary):
    import os

    from tokenizers import Tokenizer

    public = Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    public.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", "a", " \n\n x", "<|endoftext|>", "日本語" * 500, "a" * 3000, "\x00é👩‍👩‍👧", "it's I'LL", "ไทยคำ 12345678901"]
    texts += ["".join(rng.choice("abcdeéßж中文か 1.,'\n\t👍") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    flat, count = tokens.Encoder(vocabulary).encode(texts)
    at = 0
    for text, n, expected in zip(texts, count, public.encode_batch(texts, add_special_tokens=False), strict=True):
        assert flat[at : at + n].tolist() == expected.ids, repr(text)
        at += n


def test_token_column(spark, vocabulary):
    df = spark.createDataFrame([(1, "hi there", 5), (2, None, 5), (3, "", 5), (4, LONG, 5), (1, "hi there", 5)], "doc_id bigint, text string, ids int")
    got = sorted(map(tuple, tokens.encode_column(df, "doc_id", "text", vocabulary).collect()), key=lambda r: r[0])
    assert [r[0] for r in got] == [1, 1, 2, 3, 4] and got[2][1] == [] == got[3][1] and got[0][1] == got[1][1] and len(got[4][1]) == 60_001
    sizes = dict(map(tuple, tokens.encode_column(df, "doc_id", "text", vocabulary, lengths_only=True).distinct().collect()))
    assert sizes == {1: 2, 2: 0, 3: 0, 4: 60_001}
    assert tokens.encode_column(df.where("false"), "doc_id", "text", vocabulary).count() == 0


def test_term_counts(spark):
    rows = [(1, "Ab ab 土土 c"), (2, "AB-c"), (2, "AB-c"), (3, None), (4, ""), (5, "c c c"), (6, LONG)]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "id bigint, content string, term string")
    got = {(r.term, r.n): (r.occurrences, r.records) for r in terms.term_counts(df, "id", "content", 2).collect()}
    expected: dict = {}
    for _, t in set(rows):
        words = [w.lower() for w in terms.TERM.findall(t or "")]
        for k, v in Counter(" ".join(words[i : i + n]) + f"|{n}" for n in (1, 2) for i in range(len(words) - n + 1)).items():
            key = (k.split("|")[0], int(k.split("|")[1]))
            a, b = expected.get(key, (0, 0))
            expected[key] = (a + v, b + 1)
    assert got == expected
    marks = {r.term: r.mark for r in terms.marked(terms.term_counts(df, "id", "content"), df, "id", "content").collect()}
    assert marks == {"ab": "rare", "土": "rare", "c": "common", "word": "rare"}
    assert terms.term_counts(df.where("false"), "id", "content").count() == 0


@pytest.fixture(scope="module")
def machines():
    return languages.Machines([], [])


def test_families_and_common_words(machines):
    assert [f[0] for f in languages.families(["hello", "привет мир", "สวัสดี", "汉字 abc", "123", ""])] == ["latin", "cyrillic", "thai", "han", None, None]
    said = machines.languages("latin", ["the house of the man is not in this town and they have that", "der Mann ist nicht in das Haus und die Frau auch mit dem Kind"])
    assert [s[0] for s in said] == ["en", "de"]


def test_identify(spark, machines):
    mixed = "The house of the man is not in this town and they have it. " * 3 + "В работе рассматривается, как связана с серией функция почек."
    rows = [("library_docs", "1", "EN-gb", mixed), ("library_docs", "2", "fr", mixed), ("checks", "3", None, mixed), ("checks", "4", "en", None), ("checks", "5", "en", " 12 "), ("checks", "6", "und", LONG)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tab string, rec_id string, label string, text string, lang string")
    got = sorted(map(tuple, languages.wrong_or_further(languages.identify(df, machines)).collect()))
    assert [g for g in got if g[3] == "segment"] == [("checks", "3", "ru", "segment"), ("library_docs", "1", "ru", "segment"), ("library_docs", "2", "ru", "segment")]
    assert sorted(g[1] for g in got if g[3] == "main") == ["2", "3", "6"]
    assert languages.identify(df.where("false"), machines).count() == 0


def test_fit_without_labels(spark):
    df = spark.createDataFrame([], "lang string, content string")
    assert languages.fit(df, "lang", "content").languages("cyrillic", ["привет"]) == [("ru", float("inf"))]


def test_blank_batches_and_blank_labelled_rows(spark):
    """A batch of blank texts only, and a labelled row of blanks, give nothing and break nothing."""
    blank = spark.createDataFrame([("library_docs", str(k), "en", " " * 60 + "\n" * (k % 3)) for k in range(600)], "tab string, rec_id string, label string, text string")
    fitted = languages.fit(blank, "label", "text")
    assert languages.families([]) == [] and languages.identify(blank, fitted).count() == 0
    assert list(languages._spans(fitted, ["   ", "\n"])) == [[], []]


def test_short_sentences_go_by_evidence_and_neighbours(machines):
    def path(text):
        spans = next(languages._spans(machines, [text]))
        return languages.best_path(spans)

    here = "The house of the man is not in this town and they have it. "
    assert path(here + "Да, это так. " + here) == ["en", "ru", "en"]
    assert path(here + "好的。 " + here) == ["en", "zh", "en"]
    assert path(here + "Data RX-7. " + here) == ["en"] * 3
    assert languages.best_path([("en", 0, 9, 5.0, 9.0), ("pt", 9, 12, 0.3, 2.0), ("en", 12, 30, 5.0, 9.0)]) == ["en"] * 3


def test_held_out_languages(spark):
    """Machines fitted on one half of the small library tell the other half's labels, wrong labels apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/library_docs.parquet")
    fitted = languages.fit(docs.where("id % 2 = 0"), "lang", "content")
    rest = docs.where("id % 2 = 1 AND lang IN ('en', 'de', 'fr', 'es', 'pt', 'zh', 'ja', 'ru', 'th')")
    records = rest.selectExpr("'library_docs' AS tab", "cast(id AS string) AS rec_id", "lang AS label", "content AS text")
    main = languages.identify(records, fitted).where("extent = 'main'").toPandas()
    assert (main.label == main.lang).mean() > 0.9


def test_every_query_is_named():
    assert {n.split("_")[0] for n in queries.queries()} == {f"p{k}" for k in range(1, 10)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
