"""Shared spans, leakage, mixing and subjects."""

import random

import pytest
from scriven.llm import leakage, mixture, spans, subjects


def random_text(rng, n, letters="abcdefghij klmnop"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_shared_runs_find_every_span():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.randint(155, 175)
        core = random_text(rng, size)
        a = random_text(rng, rng.randint(0, 300), "xyz") + core + "Q" + random_text(rng, rng.randint(0, 200), "xyz")
        b = random_text(rng, rng.randint(0, 300), "uvw") + core + "R"
        longest = max([n for _, _, n in spans.shared_runs(a, b)], default=0)
        assert longest == size if size >= spans.LEAST else longest in (0, size)


def covered(text, other, least):
    """Places of ``text`` in a stretch of ``least`` characters that ``other`` holds."""
    held = {other[k : k + least] for k in range(len(other) - least + 1)}
    return {i for k in range(len(text) - least + 1) if text[k : k + least] in held for i in range(k, k + least)}


def test_runs_of_repetitive_texts_equal_brute_force():
    """Texts that repeat themselves are treated as all others: both sides' shared stretches are covered, with linearly many runs."""
    rng = random.Random(8)
    for _ in range(12):
        cores = [random_text(rng, n) for n in (130, 170, 300)]
        a, b = ("".join(rng.choice([*cores, "ab" * rng.randint(1, 200), random_text(rng, 40)]) for _ in range(30)) for _ in range(2))
        runs = spans.shared_runs(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs) and len(runs) < (len(a) + len(b)) / 8
        # runs are maximal
        assert all((i == 0 or j == 0 or a[i - 1] != b[j - 1]) and a[i + n : i + n + 1] != (b[j + n : j + n + 1] or "-") for i, j, n in runs)
        for side, (x, y) in enumerate(((a, b), (b, a))):
            assert {k for r in runs if r[2] >= 160 for k in range(r[side], r[side] + r[2])} == covered(x, y, 160)
    runs = spans.shared_runs("ab" * 20_000, "xx" + "ab" * 15_000)
    assert max(n for _, _, n in runs) == 30_000 and len(runs) < 20
    assert spans.shared_runs("a" * 100, "a" * 100) == []


def test_picked_seeds_of_short_runs_are_covered():
    rng = random.Random(8)
    a, b = "ab" * 2000, "xx" + "ab" * 1500
    for _ in range(20):
        core = random_text(rng, 130)
        a, b = a + random_text(rng, 200) + core, b + random_text(rng, 200) + core
    runs = spans.shared_runs(a, b)
    seeds = [spans.Windows([t]) for t in (a, b)]
    shared = set(seeds[0].seeds.tolist()) & set(seeds[1].seeds.tolist())
    for side, w in enumerate(seeds):
        for h, p in zip(w.seeds.tolist(), w.places.tolist(), strict=True):
            assert h not in shared or any(r[side] <= p and p + 80 <= r[side] + r[2] for r in runs)
    assert sum(n < 160 for _, _, n in runs) > 5
    assert spans._gap_matches("x" * 3000 + "abc", "abc" + "y" * 900) == 3


def test_no_record_stands_for_a_whole_hot_class(spark):
    """One window in 40 000 records: every record has a partner, and none has more than a set number of them."""
    from collections import Counter

    core = random_text(random.Random(9), 170)
    texts = spark.range(40_000).selectExpr("xxhash64(id) AS no", f"concat('{core}', '#', id) AS text")
    pairs = spans.record_pairs(texts.unionByName(texts.limit(50))).collect()
    partners = Counter(x for p in pairs for x in (p.a, p.b))
    assert len(partners) == 40_000 and max(partners.values()) <= 8 * spans.MEMBERS


def test_chains_are_collinear_and_complete():
    rng = random.Random(2)
    for _ in range(50):
        runs = sorted({(rng.randint(0, 900), rng.randint(0, 900), rng.randint(80, 120)) for _ in range(12)})
        chains = spans.chains(runs)
        assert sorted(r for c in chains for r in c) == runs
        for c in chains:
            assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(c, c[1:], strict=False))
        # the best chain scores as much as an exhaustive search
        score = {}
        for r in runs:
            score[r] = r[2] + max([0, *(score[q] - 0.5 * (r[0] - q[0] - q[2] + r[1] - q[1] - q[2]) for q in score if q[0] + q[2] <= r[0] and q[1] + q[2] <= r[1])])
        top = chains[0]
        assert abs(sum(r[2] for r in top) - 0.5 * sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(top, top[1:], strict=False)) - max(score.values())) < 1e-6


def test_fuzzy_passage():
    rng = random.Random(3)
    x, y = random_text(rng, 200), random_text(rng, 200)
    (found,) = spans.passages("--" + x + "12345" + y, x + "123x5" + y + "++")
    assert found[:4] == (2, 407, 0, 405) and found[4] == pytest.approx(404 / 405)


def brute(rows, least=160):
    held = {}
    for tab, rec, text in rows:
        for k in range(len(text or "") - least + 1):
            held.setdefault(text[k : k + least], set()).add((tab, rec))
    return {r for s in held.values() if len(s) > 1 for r in s}


def test_shared_records_equal_brute_force(spark):
    rng = random.Random(4)
    cores = [random_text(rng, 400) for _ in range(4)]
    rows = [("checks", "n", None), ("checks", "e", ""), ("checks", "l", random_text(rng, 30_000))]
    for k in range(120):
        core = rng.choice(cores)
        at, size = rng.randint(0, 200), rng.randint(140, 200)
        rows.append((rng.choice(["library_docs", "checks"]), str(k), random_text(rng, rng.randint(0, 200)) + core[at : at + size] + random_text(rng, 50)))
    rows += [("library_docs", f"hot{k}", cores[0]) for k in range(60)] + rows[:20]
    rows += [("checks", "self", "7" + (cores[1][:10] + "8") * 40)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "tab string, rec_id string, text string, a string")
    found = spans.shared_passages(df)
    assert {tuple(r) for r in spans.shared_records(found).collect()} == brute(set(rows))
    share = {(r.tab, r.rec_id): r for r in spans.shared_share(found, df).collect()}
    assert share["library_docs", "hot3"].shared_chars == 400 and share["library_docs", "hot3"].spans == 1 and share["library_docs", "hot3"].share == 1.0
    assert share["checks", "e"].share == 0.0 and ("checks", "n") not in share
    assert spans.shared_passages(df.where("false")).count() == 0


def test_passages_and_members_hold_every_link(spark):
    rng = random.Random(7)
    cores = [random_text(rng, 400) for _ in range(2)]
    rows = [("checks", "n", None), ("checks", "e", "")]
    for k in range(40):
        core = rng.choice(cores)
        at, size = rng.randint(0, 200), rng.randint(100, 200)
        rows.append((rng.choice(["library_docs", "checks"]), str(k), random_text(rng, rng.randint(0, 200)) + core[at : at + size] + random_text(rng, 100)))
    rows += [("library_docs", "twice", rows[5][2] + "7" + rows[5][2])] + rows[:10]
    text = {(tab, rec): t for tab, rec, t in rows if t}
    windows = {r: {t[k : k + 160] for k in range(len(t) - 159)} for r, t in text.items()}
    seeds = {r: set(spans.Windows([t]).seeds.tolist()) for r, t in text.items()}
    exact = {(a, b) for a in text for b in text if a != b and windows[a] & windows[b]}
    fuzzy = {(a, b) for a in text for b in text if a != b and seeds[a] & seeds[b]}
    df = spark.createDataFrame(rows, "tab string, rec_id string, text string")
    found = spans.shared_passages(df).collect()
    listed = {((r.tab, r.rec_id), (r.other_tab, r.other_id)) for r in found}
    long = {((r.tab, r.rec_id), (r.other_tab, r.other_id)) for r in found if r.longest >= 160}
    members = spans.shared_members(df)
    head = {(r.length, r.tab, r.rec_id, r.start_pos, r.end_pos, r.head_tab, r.head_id, r.head_start) for r in members.collect()}
    assert len(head) == members.count()
    assert all(text[a, b][i:j] == text[c, d][k : k + j - i] for _, a, b, i, j, c, d, k in head)
    got = spans.links(members).collect()
    assert all(text[r.tab, r.rec_id][r.start_pos :][: r.chars] == text[r.other_tab, r.other_id][r.other_start :][: r.chars] for r in got)
    by = {n: {((r.tab, r.rec_id), (r.other_tab, r.other_id)) for r in got if r.length == n} for n in (80, 160)}
    assert long < exact and long | by[160] == exact and listed < fuzzy and listed | by[80] == fuzzy
    # every record of a shared seed has a passage
    assert {a for a, _ in listed} == {a for a, _ in fuzzy}
    assert spans.shared_members(df.where("false")).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, lang, random_text(rng, 300, "abcdefghijklmnopqrstuvw  " if lang == "en" else "的一是在不了有和人这中大为上个国我以要他")) for k, lang in enumerate(["en", "zh"] * 6)]
    items += [(50, "en", None), (51, "en", "short"), (52, "fr", items[0][2]), (53, None, items[0][2]), (54, "en", items[0][2]), (0, "en", items[0][2])]
    docs = [(900, None), (901, ""), (902, random_text(rng, 50_000))]
    for k in range(150):
        _, lang, text = rng.choice(items[:12])
        clean = text.replace(" ", "")
        size = rng.randint(70, 100) if lang == "en" else rng.randint(26, 40)
        at = rng.randint(0, len(clean) - size)
        part = clean[at : at + size]
        part = part.upper() if k % 3 == 0 else part.replace("a", "а") if k % 3 == 1 else "-".join(part)
        docs.append((k, random_text(rng, 40, "0123456789") + part + random_text(rng, 40, "0123456789")))
    docs.append(docs[5])
    df = spark.createDataFrame([(*d, 1) for d in docs], "id bigint, content string, item_id int")
    ev = spark.createDataFrame(items, "item_id bigint, lang string, text string")
    expected = set()
    for i, lang, text in items:
        run = leakage.RUN.get(lang or "")
        t = leakage.kept(text)
        for d, content in docs:
            c = leakage.kept(content)
            if run and any(t[k : k + run] in c for k in range(len(t) - run + 1)):
                expected.add((d, i))
    got = leakage.leaks(df, "id", "content", ev)
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected) > 20
    assert leakage.leaks(df.where("false"), "id", "content", ev).count() == 0
    assert leakage.leaks(df, "id", "content", ev.where("false")).count() == 0


def test_mixture(spark):
    rows = [(k, "big", 10) for k in range(1000)] + [(2000 + k, "small", 7) for k in range(30)] + [(3000 + k, "other", 5) for k in range(400)]
    rows += [(5000, None, 9), (5001, "nowhere", 9), (5002, "big", 0), (5003, "big", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, n_tokens bigint, copy int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 4), ("other", 0.25, 2), ("ghost", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs, targets)
    got = {r.source: r for r in mixture.shares(mixed, docs, targets).collect()}
    assert got["ghost"].tokens == 0 and set(got) == {"big", "small", "other", "ghost"}
    assert got["small"].copies == 4 and got["small"].tokens == 840
    for s, share in (("big", 0.5), ("small", 0.2), ("other", 0.25)):
        assert got[s].actual_share == pytest.approx(share / 0.95, abs=0.01) and got[s].copies <= got[s].max_repeats
    rows = mixed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    late = lambda s: sum(r.position > 0.5 for r in rows if r.source == s) / sum(r.source == s for r in rows)
    assert late("small") > 0.55 > 0.5 > late("big")
    assert mixture.mix(docs.where("false"), targets).count() == 0 and mixture.mix(docs, targets.where("false")).count() == 0


def test_mixture_meets_the_target_of_a_tiny_source(spark):
    rows = [(k, "big", 10) for k in range(2000)] + [(3000 + k, "other", 10) for k in range(2000)] + [(6000 + k, "tiny", 1) for k in range(98)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("other", 0.451, 1), ("tiny", 0.049, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixture.shares(mixture.mix(docs, targets), docs, targets).collect()}
    assert got["tiny"].tokens == 196
    assert all(r.actual_share == pytest.approx(r.target_share, abs=0.005) for r in got.values())
    # the larger mix, which starves the tiny source, is an option
    more = {r.source: r for r in mixture.shares(mixture.mix(docs, targets, 0.05), docs, targets).collect()}
    assert more["big"].tokens > 5 * got["big"].tokens and more["tiny"].actual_share < 0.01


def test_nearest_sum():
    import itertools

    rng = random.Random(13)
    for _ in range(100):
        sizes, wanted = [rng.randint(1, 40) for _ in range(rng.randint(0, 8))], rng.randint(0, 120)
        best = min((abs(sum(c) - wanted) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n)), default=wanted)
        found = mixture.nearest_sum(sizes, wanted)
        assert len(set(found)) == len(found) and abs(sum(sizes[k] for k in found) - wanted) == best


def test_shares_are_within_two_percent_of_feasible_targets(spark):
    """Long documents at the edge of a source's demand are passed over for ones that fit."""
    rng = random.Random(12)
    rows = [(k, s, rng.choice([3, 40, 90, 250, 4000 if s == "long" else 300])) for s in ("long", "plain", "wide") for k in range(len(s) * 100, len(s) * 100 + 60)]
    docs = spark.createDataFrame([(i * 10 + len(s), s, n, "x") for i, s, n in rows], "doc_id bigint, source string, n_tokens bigint, copy string")
    targets = spark.createDataFrame([("long", 0.1, 2), ("plain", 0.6, 3), ("wide", 0.2, 3), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    for r in mixture.shares(mixture.mix(docs, targets), docs, targets).collect():
        assert r.source == "none" or abs(r.actual_share / (r.target_share / 0.9) - 1) < 0.02, r


def test_pattern_growth_equals_counting():
    """Every pattern that is surer than its parts is grown, with the confidence that plain counting gives; closed ones only."""
    import itertools

    rng = random.Random(6)
    tree, rows = subjects.PrefixTree(2), []
    for _ in range(300):
        s = rng.randint(0, 1)
        ranks = sorted(rng.sample(range(8), rng.randint(1, 5)) if s else rng.sample(range(2, 8), rng.randint(1, 4)))
        rows.append((frozenset(ranks), s))
        tree.add(tuple(ranks), [float(s == 0), float(s == 1)])

    def sure(p, s):
        inside = [k for r, k in rows if p <= r]
        return (inside.count(s) + subjects.SHRINK / 2) / (len(inside) + subjects.SHRINK)

    got = {frozenset(p): (s, c) for p, s, c in tree.grow(None, 0.6, 3)}
    assert got and all(abs(sure(p, s) - c) < 1e-9 and c >= 0.6 for p, (s, c) in got.items())
    assert max(map(len, got)) >= 2
    for n in (1, 2, 3):
        for p in map(frozenset, itertools.combinations(range(8), n)):
            s = max((0, 1), key=lambda s: sure(p, s))
            parts = [q for k in range(1, n) for q in map(frozenset, itertools.combinations(p, k))]
            whole = sum(p <= r for r, _ in rows)
            # surer than all its parts by the gain, every part half sure, and no part has the same sentences
            if whole >= 3 and sure(p, s) >= 0.6 and all(sure(q, s) + subjects.GAIN < sure(p, s) and sure(q, s) >= 0.3 and sum(q <= r for r, _ in rows) > whole for q in parts):
                assert p in got, p


def test_subjects(spark):
    law = "The court heard the contract dispute number {}. A judge read the statute again."
    sport = "The goalkeeper saved the penalty kick {}. Our coach praised the marathon runner."
    docs = [(k, (law if k % 2 else sport).format(k)) for k in range(60)] + [(100, None), (101, ""), (102, "Nothing of note happened today."), (103, law.format(1) + " " + sport.format(2)), (104, " filler" * 30_000)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(k, " LAW" if k % 2 else "sport", None) for k in range(20)] + [(0, "sport", None), (1, "unknown", "x"), (None, "law", None)], "doc_id bigint, subject string, labelled_by string")
    areas = spark.createDataFrame([("law", "x"), ("sport", "y")], "subject string, scope_note string")
    found = subjects.score(df, subjects.fit(df, labels, areas)).where("share >= 0.2").collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got[k] == {"law" if k % 2 else "sport"} for k in range(60))
    assert got[103] == {"law", "sport"} and not {100, 101, 102, 104} & set(got)
    assert subjects.score(df, subjects.fit(df, labels.where("false"), areas)).count() == 0


def test_subjects_of_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/subject_labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    areas = spark.read.parquet("/root/testdata/sf0.1/subject_areas.parquet")
    held = subjects.clean_labels(labels, areas).where("pmod(doc_id, 4) = 0")
    rules = subjects.fit(docs, labels.where("pmod(doc_id, 4) <> 0"), areas)
    found = subjects.score(docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi"), rules).where("share >= 0.2")
    assert held.join(found, ["doc_id", "subject"], "left_semi").count() > 0.8 * held.count()
