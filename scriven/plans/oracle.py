"""DuckDB SQL of the queries: common table expressions, put together by name."""

from __future__ import annotations

import re

from ..functions import constants as K

_Q, _E = "“”\"‘’", "。！？；!?;"
# RE2 has no look-ahead: dots inside words are masked by a private-use character first
_TILE = rf"(?s)(?:[^{_Q}{_E}.\n]|[{_Q}][^{_Q}]*(?:[{_Q}]|\z))*(?:[{_E}.\n]|\z)"
_SOLID = r"[^\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _round(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits} + 0.5) / {10**digits})"


def _clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {float(low)}), {float(high)})"


def _kind(t: str) -> str:
    zh, en = f"length(regexp_replace({t}, '[^一-鿿]', '', 'g'))", f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    return f"(CASE WHEN {zh} >= {en} THEN 'zh' WHEN {zh} < {en} THEN 'en' END)"


_WORDS = "regexp_extract_all(lower({t}), '[A-Za-z0-9'']+')"


def _norm(t: str, kind: str) -> str:
    return f"(CASE WHEN {kind} = 'zh' THEN regexp_replace({t}, '[^一-鿿A-Za-z0-9]', '', 'g') ELSE array_to_string({_WORDS.format(t=t)}, ' ') END)"


def _units(norm: str, kind: str) -> str:
    return f"(CASE WHEN {kind} = 'zh' THEN length({norm}) WHEN {norm} = '' THEN 0 ELSE len(string_split({norm}, ' ')) END)::INT"


def _shingles(norm: str, kind: str, n: str, least: int = K.MIN_SENT_UNITS) -> str:
    zh, en = K.ZH_SHINGLE, K.EN_SHINGLE
    return f"""list_distinct(CASE WHEN {n} < {least} THEN []
      WHEN {kind} = 'zh' AND {n} >= {zh} THEN list_transform(range(1, {n} - {zh} + 2), lambda i: substr({norm}, i, {zh}))
      WHEN {kind} <> 'zh' AND {n} >= {en} THEN list_transform(range(1, {n} - {en} + 2), lambda i: array_to_string(list_slice(string_split({norm}, ' '), i, i + {en} - 1), ' '))
      ELSE [{norm}] END)"""


def _hits(t: str, phrases: tuple[str, ...]) -> str:
    parts = " + ".join(f"(length({t}) - length(replace({t}, {_lit(p)}, ''))) / {len(p)}" for p in phrases)
    return f"round({parts})::INT"


def _phrases(t: str, lang: str, zh: tuple[str, ...], en: tuple[str, ...]) -> str:
    return f"(CASE WHEN {lang} = 'zh' THEN {_hits(t, zh)} ELSE {_hits(f'lower({t})', en)} END)"


def _sentences(docs: str) -> str:
    """Sentences of a table (doc_id, text)."""
    masked = r"regexp_replace(text, '\.([\p{L}\p{N}])', chr(57344) || '\1', 'g')"
    return f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) - 1)::INT AS idx, start_pos, (start_pos + length(text))::INT AS end_pos,
        text, kind, norm, {_units("norm", "kind")} AS units
      FROM (SELECT *, {_norm("text", "kind")} AS norm FROM (SELECT *, {_kind("text")} AS kind FROM (
        SELECT doc_id, (sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY k) - length(tile))::INT AS start_pos,
          CASE WHEN ends_with(tile, chr(10)) AND length(regexp_replace(tile, '[^{_Q}]', '', 'g')) % 2 = 0 THEN substr(tile, 1, length(tile) - 1) ELSE tile END AS text
        FROM (SELECT doc_id, unnest(list_transform(t, lambda x: replace(x, chr(57344), '.'))) AS tile, generate_subscripts(t, 1) AS k
              FROM (SELECT doc_id, regexp_extract_all({masked}, {_lit(_TILE)}) AS t FROM {docs})))
        WHERE regexp_matches(text, {_lit(_SOLID)})))"""


_CTE = {
    "lib": "SELECT DISTINCT id AS doc_id, title, content AS text, is_builtin FROM library_docs WHERE content IS NOT NULL",
    "paper": "SELECT DISTINCT id AS doc_id, array_to_string(json_extract_string(report, '$.plagiarism.sent_results[*].text'), ' ') AS text FROM checks WHERE report IS NOT NULL",
    "body": "SELECT doc_id, text FROM paper",
    "lib_all": _sentences("lib"),
    "psent": _sentences("body"),
    "lsent": f"SELECT * REPLACE ((row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) - 1)::INT AS idx) FROM lib_all WHERE units >= {K.MIN_LIBRARY_UNITS}",
    "lsh": f"SELECT doc_id, idx, kind, norm, {_shingles('norm', 'kind', 'units')} AS sh FROM lsent",
    "lshx": "SELECT doc_id, idx, len(sh) AS nc, unnest(sh) AS shingle FROM lsh",
    "df": "SELECT shingle, count(DISTINCT doc_id)::BIGINT AS df FROM lshx GROUP BY shingle",
    # query and candidate sentences by normal form
    "qcls": "SELECT DISTINCT kind, norm, units FROM psent",
    "qsh": f"SELECT kind, norm, len(sh) AS nq, unnest(sh) AS shingle FROM (SELECT kind, norm, {_shingles('norm', 'kind', 'units')} AS sh FROM qcls)",
    "qw": "SELECT q.*, ln(1 + greatest((SELECT count(*) FROM lib), 1) / greatest(coalesce(df, 1), 1)) AS w FROM qsh q LEFT JOIN df USING (shingle)",
    "qtot": "SELECT kind, norm, sum(w) AS total_w FROM qw GROUP BY kind, norm",
    "lcls": "SELECT kind, norm, len(any_value(sh)) AS nc, any_value(sh) AS sh FROM lsh GROUP BY kind, norm",
    "lclsx": "SELECT kind AS ckind, norm AS cnorm, nc, unnest(sh) AS shingle FROM lcls",
    "met": "SELECT q.kind, q.norm, ckind, cnorm, count(*)::BIGINT AS hits, sum(w) AS shared_w, max(nq) AS nq, max(nc) AS nc FROM qw q JOIN lclsx USING (shingle) GROUP BY ALL",
    "cand": f"SELECT kind, norm, ckind, cnorm, hits, hits / least(nq, nc) AS containment, {_round('shared_w / total_w', 9)} AS coverage FROM met JOIN qtot USING (kind, norm)",
    "ranked": "SELECT c.*, l.doc_id, l.idx, row_number() OVER (PARTITION BY c.kind, c.norm ORDER BY hits DESC, l.doc_id, l.idx) AS rank FROM cand c JOIN lsent l ON l.kind = ckind AND l.norm = cnorm",
    "passed": f"SELECT * FROM (SELECT *, {_round('least(containment, 0.5 + 0.5 * coverage)', 4)} AS sim FROM ranked WHERE rank <= {K.RECALL_CUT}) WHERE coverage >= {K.COVERAGE_FLOOR} AND sim >= CASE WHEN kind = 'zh' THEN {K.ZH_SIM_THRESHOLD} ELSE {K.EN_SIM_THRESHOLD} END",
    "first_": "SELECT kind, norm, doc_id, arg_min(idx, rank) AS sent_idx, arg_min(sim, rank) AS sim, min(rank) AS rank FROM passed GROUP BY kind, norm, doc_id",
    "top3": f"SELECT *, row_number() OVER (PARTITION BY kind, norm ORDER BY sim DESC, rank)::INT AS place FROM (SELECT * FROM first_ QUALIFY row_number() OVER (PARTITION BY kind, norm ORDER BY rank) <= {K.TOP_SOURCES})",
    "matches": "SELECT p.doc_id AS paper_id, p.idx, place, t.doc_id, t.sent_idx, t.sim FROM psent p JOIN top3 t USING (kind, norm)",
    "quoted": """SELECT doc_id, idx, coalesce(list_sum(list_transform(regexp_extract_all(text, '“[^”]*”|"[^"]*"|‘[^’]*’'),
        lambda s: CASE WHEN kind = 'zh' THEN length(s) - 2 ELSE len(regexp_extract_all(substr(s, 2, length(s) - 2), '\\S+')) END)), 0)::INT AS quote_units FROM {}""",
    "results": "SELECT p.*, m.doc_id AS source_id, m.sim, m.paper_id IS NOT NULL AS matched, q.quote_units FROM psent p LEFT JOIN (SELECT * FROM matches WHERE place = 1) m ON m.paper_id = p.doc_id AND m.idx = p.idx JOIN pquoted q ON q.doc_id = p.doc_id AND q.idx = p.idx",
    "totals": "SELECT doc_id, sum(units) AS total_units FROM results GROUP BY doc_id",
    "sources": f"SELECT doc_id, source_id, dup_units, hits, {_round('dup_units / total_units * 100', 1)} AS rate FROM (SELECT doc_id, source_id, sum(units)::BIGINT AS dup_units, count(*)::BIGINT AS hits FROM results WHERE matched GROUP BY ALL) JOIN totals USING (doc_id)",
    "hit": f"SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS fragment FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) > {K.FRAGMENT_GAP + 1} THEN 1 ELSE 0 END AS new FROM results WHERE matched)",
    "spans": "SELECT doc_id, fragment, min(idx) AS first_idx, max(idx) AS last_idx, min(start_pos) AS start_pos, max(end_pos) AS end_pos, sum(units)::BIGINT AS dup_units FROM hit GROUP BY ALL",
    "fsrc": "SELECT doc_id, fragment, source_id, sum(units) AS u, min(idx) AS met, arg_min(sim, idx) AS sim FROM hit GROUP BY ALL",
    "ftop": "SELECT * FROM fsrc QUALIFY row_number() OVER (PARTITION BY doc_id, fragment ORDER BY u DESC, met) = 1",
    "grams": """SELECT doc_id, unnest(CASE WHEN kind = 'zh' THEN list_transform(range(1, greatest(1, length(norm) - 3) + 1), lambda i: substr(norm, i, 4))
        ELSE list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS gram
      FROM (SELECT *, string_split(norm, ' ') AS w FROM (SELECT doc_id, kind, """
    + _norm("text", "kind")
    + " AS norm FROM (SELECT *, "
    + _kind("text")
    + " AS kind FROM lib)))",
    "prints": "SELECT doc_id, "
    + " | ".join(f"(CASE WHEN sum(((h >> {b}) & 1)::INT * 2 - 1) > 0 THEN {2**b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))
    + " AS fp FROM (SELECT doc_id, ('0x' || substr(md5(gram), 1, 16))::UBIGINT AS h FROM grams) GROUP BY doc_id",
    "ldoc": "SELECT doc_id, string_agg(norm, ' ' ORDER BY idx) AS norm, max(CASE WHEN idx < 3 AND regexp_matches(norm, '[一-鿿]') THEN 1 ELSE 0 END) AS zh FROM lsent GROUP BY doc_id",
    "ltok": "SELECT doc_id, CASE WHEN zh = 1 THEN regexp_extract_all(norm, '(?s).') ELSE regexp_extract_all(norm, '[^ ]+') END AS t FROM ldoc WHERE length(norm) > 100",
    "uni": "SELECT g1, count(*)::BIGINT AS n FROM (SELECT unnest(t) AS g1 FROM ltok) GROUP BY ALL",
    "bi": "SELECT g.a AS g1, g.b AS g2, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: {'a': t[i], 'b': t[i + 1]})) AS g FROM ltok) GROUP BY ALL",
    "tri": "SELECT g.a AS g1, g.b AS g2, g.c AS g3, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: {'a': t[i], 'b': t[i + 1], 'c': t[i + 2]})) AS g FROM ltok) GROUP BY ALL",
    "size_": "SELECT (SELECT count(*) FROM uni) AS v, (SELECT coalesce(sum(greatest(0, len(t) - 2)), 0) FROM ltok) AS total",
    "plang": f"SELECT *, {_kind('text')} AS lang FROM paper",
    "kept": "SELECT s.*, p.lang FROM psent s JOIN plang p USING (doc_id) WHERE units >= 3",
    "ktok": "SELECT kind, norm, t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT DISTINCT kind, norm, CASE WHEN kind = 'zh' THEN regexp_extract_all(norm, '(?s).') ELSE regexp_extract_all(norm, '[^ ]+') END AS t FROM kept) WHERE len(t) >= "
    + str(K.MIN_LM_TOKENS),
    "logs": f"""SELECT k.kind, k.norm, ln(greatest(0.6 * CASE WHEN coalesce(bi.n, 0) > 0 THEN (coalesce(tri.n, 0) + {K.ADD_K}) / (bi.n + {K.ADD_K} * v) ELSE 0.0 END
        + 0.4 * (coalesce(uni.n, 0) + {K.ADD_K}) / (total + {K.ADD_K} * greatest(v, 1)), 1e-12)) AS lp
      FROM (SELECT kind, norm, t[i] AS a, t[i + 1] AS b, t[i + 2] AS c FROM ktok) k CROSS JOIN size_
      LEFT JOIN tri ON tri.g1 = a AND tri.g2 = b AND tri.g3 = c LEFT JOIN bi ON bi.g1 = a AND bi.g2 = b LEFT JOIN uni ON uni.g1 = c""",
    "stats": "SELECT kind, norm, exp(-avg(lp)) AS ppl, CASE WHEN count(*) >= 3 THEN stddev_pop(lp) ELSE 0.0 END AS burst, CASE WHEN count(*) >= 3 AND avg(lp) <> 0 THEN stddev_pop(lp) / abs(avg(lp)) END AS token_burst FROM logs WHERE (SELECT total FROM size_) > 1000 GROUP BY kind, norm",
    "whole": f"""SELECT doc_id, lang, {_phrases("text", "lang", K.ZH_CONNECTORS, K.EN_CONNECTORS)} AS conn, {_phrases("text", "lang", K.ZH_CLICHES, K.EN_CLICHES)} AS cliche,
        greatest(1, len(list_distinct(tk)))::INT AS types, greatest(1, len(tk))::INT AS tokens, len(list_distinct(regexp_extract_all(text, '[,;:!?()【】《》“”‘’、—…]')))::INT AS marks
      FROM (SELECT *, CASE WHEN lang = 'zh' THEN regexp_extract_all(regexp_replace(text, '[^一-鿿A-Za-z0-9]', '', 'g'), '(?s).') ELSE {_WORDS.format(t="text")} END AS tk FROM plang)""",
    "per": """SELECT doc_id, count(*)::BIGINT AS n, avg(units) AS mean_len, stddev_pop(units) AS sd_len, count(DISTINCT substr(text, 1, 2))::BIGINT AS heads, count(ppl) AS ppls,
        stddev_pop(ppl) / avg(ppl) AS ppl_cv, count(token_burst) AS bursts, avg(token_burst) AS mean_burst FROM kept LEFT JOIN stats USING (kind, norm) GROUP BY doc_id""",
    "feat": f"""SELECT *, sd_len / mean_len AS len_cv, conn / n AS conn_density, cliche / n AS cliche_density,
        {_clamp("1 - abs(types / tokens - CASE WHEN lang = 'zh' THEN 0.52 ELSE 0.42 END) / CASE WHEN lang = 'zh' THEN 0.25 ELSE 0.30 END", 0, 1)} AS ttr_score,
        1 - {_clamp("marks / 12", 0, 1)} AS punct_score, heads / n AS head_div,
        CASE WHEN ppls >= 3 THEN {_clamp(f"1 - ppl_cv / {K.SENTENCE_ANCHOR}", 0, 1)} END AS sent_burst, CASE WHEN bursts >= 2 THEN {_clamp(f"1 - mean_burst / {K.TOKEN_ANCHOR}", 0, 1)} END AS token_burst
      FROM whole JOIN per USING (doc_id)""",
    "feats": f"""SELECT *, {_round("100 / (1 + exp(-" + _round("1.05 * z", 9) + "))", 1)} AS doc_score FROM (SELECT *, 1.4 * (1 - {_clamp("len_cv / 0.55", 0, 1)}) + 0.9 * {_clamp("conn_density / 0.45", 0, 1.5)}
        + 1.4 * {_clamp("cliche_density / 0.35", 0, 1.5)} + 0.7 * ttr_score + 0.6 * punct_score + 0.7 * (1 - {_clamp("head_div", 0, 1)}) / 0.6 - 2.2
        + coalesce(0.8 * sent_burst, 0.0) + coalesce(0.7 * token_burst, 0.0) AS z FROM feat)""",
    "ks": """SELECT k.*, token_burst, substr(text, 1, 2) AS head, CASE WHEN lang = 'zh' THEN substr(text, 1, 2) ELSE array_to_string(list_slice(regexp_extract_all(lower(text), '\\S+'), 1, 2), ' ') END AS opener,
        avg(units) OVER d AS mean_len, count(token_burst) OVER d AS bursts, row_number() OVER (PARTITION BY doc_id ORDER BY token_burst NULLS LAST, idx) AS nth
      FROM kept k LEFT JOIN stats USING (kind, norm) WINDOW d AS (PARTITION BY doc_id)""",
    "often": "SELECT doc_id, head AS opener, count(*) AS uses FROM ks GROUP BY ALL HAVING count(*) >= 3",
    "kz": f"""SELECT *, 1.5 * {_phrases("text", "lang", K.ZH_CLICHES, K.EN_CLICHES)} + 0.6 * {_phrases("text", "lang", K.ZH_CONNECTORS, K.EN_CONNECTORS)}
        + 0.8 * (1 - {_clamp("abs(units - mean_len) / mean_len / 0.7", 0, 1)}) + CASE WHEN uses IS NOT NULL THEN 0.5 ELSE 0.0 END - 1.1
        + coalesce(CASE WHEN median > 0 AND token_burst IS NOT NULL THEN 0.5 * {_clamp("(median - token_burst) / median / 0.5", 0, 1.2)} END, 0.0) AS z
      FROM (SELECT ks.*, uses, max(CASE WHEN nth = floor(bursts / 2) + 1 THEN token_burst END) OVER (PARTITION BY ks.doc_id) AS median FROM ks LEFT JOIN often USING (doc_id, opener))""",
    "scores": f"SELECT doc_id, idx, start_pos, end_pos, score, CASE WHEN score >= {K.AIGC_HIGH} THEN 'high' WHEN score >= {K.AIGC_MID} THEN 'mid' ELSE 'low' END AS level FROM (SELECT *, {_round('100 / (1 + exp(-' + _round('1.4 * z', 9) + '))', 1)} AS score FROM kz)",
    "final": f"SELECT p.doc_id, coalesce({_round(_round('mean * 0.6 + doc_score * 0.4', 9), 1)}, 0.0) AS total_rate FROM paper p LEFT JOIN feats USING (doc_id) LEFT JOIN (SELECT doc_id, sum(score * (end_pos - start_pos)) / sum(end_pos - start_pos) AS mean FROM scores GROUP BY doc_id) USING (doc_id)",
}
_CTE["pquoted"] = _CTE["quoted"].format("psent")
_CTE["lquoted"] = _CTE["quoted"].format("lib_all")
del _CTE["quoted"]


def _with(select: str, **own: str) -> str:
    """``select`` with the expressions it names, those first that others need. ``own`` replaces or adds expressions."""
    texts = _CTE | own
    order: list[str] = []

    def visit(sql: str, seen: tuple[str, ...]) -> None:
        for name in re.findall(r"[a-z_0-9]+", sql):
            if name in texts and name not in order and name not in seen and re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql):
                visit(texts[name], (*seen, name))
                order.append(name)

    visit(select, ())
    return ("WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in order) + "\n" if order else "") + select


def _fold(text: str, table: dict[str, str]) -> str:
    for k in sorted(table, key=lambda k: -len(k)):
        text = f"replace({text}, {_lit(k)}, {_lit(table[k])})"
    return text


def _synonyms_zh(text: str) -> str:
    out = text
    for k, v in K.SYN_ZH.items():
        # an empty search would match nothing; a private-use character stands for it
        out = f"replace({out}, CASE WHEN contains({text}, {_lit(k)}) THEN {_lit(k)} ELSE chr(57345) END, {_lit(v)})"
    return out


def _synonyms_en(text: str) -> str:
    for k in sorted(K.SYN_EN, key=lambda k: k not in K.SYN_EN.values()):
        text = f"regexp_replace({text}, '(?i)\\b{k}\\b', {_lit(K.SYN_EN[k])}, 'g')"
    return text


def _opener(text: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({text}, {_lit(h)}) THEN {_lit(h)}" for h in K.CONNECTOR_HEADS_ZH) + " END"


_EVAL = {
    "paper": "SELECT DISTINCT item_id AS doc_id, text FROM aigc_eval WHERE text IS NOT NULL",
    "scored": "SELECT e.doc_id, lang, label, total_rate AS score FROM (SELECT DISTINCT item_id AS doc_id, lang, (label = 'ai')::INT AS label FROM aigc_eval WHERE text IS NOT NULL) e JOIN final USING (doc_id)",
    "twice": "SELECT * FROM scored UNION ALL SELECT * REPLACE ('all' AS lang) FROM scored",
    "area": f"SELECT lang, {_round('won / (p * n)', 6)} AS auroc FROM (SELECT lang, sum(r * label) - sum(label) * (sum(label) + 1) / 2 AS won, sum(label) AS p, sum(1 - label) AS n FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM twice) GROUP BY lang)",
    "swept": "SELECT lang, threshold, sum((score >= threshold AND label = 1)::INT) AS tp, sum((score >= threshold AND label = 0)::INT) AS fp, sum(label) AS p, sum(1 - label) AS n FROM twice, (SELECT unnest(range(5, 96, 5))::INT AS threshold) GROUP BY ALL",
    "rated": f"SELECT lang, threshold, {_round('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END', 6)} AS precision, {_round('CASE WHEN p > 0 THEN tp / p ELSE 0.0 END', 6)} AS recall, {_round('CASE WHEN tp + fp + p > 0 THEN 2 * tp / (2 * tp + fp + p - tp) ELSE 0.0 END', 6)} AS f1, {_round('CASE WHEN n > 0 THEN fp / n ELSE 0.0 END', 6)} AS fpr FROM swept",
}

_FEATURES = {
    "even_lengths": f"(1 - {_clamp('len_cv / 0.55', 0, 1)}) * 100",
    "cliches": f"{_clamp('cliche_density / 0.35', 0, 1.5)} * 66",
    "connectors": f"{_clamp('conn_density / 0.45', 0, 1.5)} * 66",
    "plain_words": "ttr_score * 100",
    "plain_marks": "punct_score * 100",
    "same_heads": f"(1 - {_clamp('head_div', 0, 1)}) * 100 / 0.6",
    "even_sentences": "sent_burst * 100",
    "even_tokens": "token_burst * 100",
}


def _split_long(text: str) -> str:
    zh_units = f"length(regexp_replace({text}, '[^一-鿿A-Za-z0-9]', '', 'g'))"
    commas = f"list_filter(range(0, length({text})), lambda i: substr({text}, (i + 1)::BIGINT, 1) = '，')"
    best = f"list_sort(list_transform({commas}, lambda i: {{'d': abs(i - length({text}) * 0.45), 'i': i}}))[1].i"
    zh = f"CASE WHEN {zh_units} >= 34 AND len({commas}) >= 2 AND {best} > 6 AND {best} < length({text}) - 6 THEN left({text}, ({best})::BIGINT) || '。' || substr({text}, ({best} + 2)::BIGINT) ELSE {text} END"
    words = rf"len(regexp_extract_all({text}, '[^ \\t\\n\\x0B\\f\\r]+'))"
    en = f"CASE WHEN {words} >= 26 AND position('; ' IN {text}) > 0 THEN left({text}, position('; ' IN {text}) - 1) || '. ' || substr({text}, position('; ' IN {text}) + 2) ELSE {text} END"
    return f"(CASE WHEN kind = 'zh' THEN {zh} ELSE {en} END)"


def _edits(mode: str) -> str:
    """Changed sentences of papers."""
    blank = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]"
    trim = lambda t: f"regexp_replace(regexp_replace({t}, '^{blank}+', ''), '{blank}+$', '')"
    styled = "coalesce(level <> 'low', false)" if mode != "dedup" else "false"
    copied = "matched" if mode != "humanize" else "false"
    swap = f"CASE WHEN kind = 'en' THEN {_fold('text', K.CLICHE_EN)} ELSE {_fold('text', K.CLICHE_ZH)} END"
    same = f"CASE WHEN kind = 'en' THEN {_synonyms_en('t2')} ELSE {_synonyms_zh('t2')} END"
    split = "true" if mode == "humanize" else "copied"
    return f"""SELECT * FROM (SELECT *, {trim('t4')} AS new, list_filter([CASE WHEN text <> t1 THEN 'stock phrase' END, CASE WHEN t1 <> t2 THEN 'repeated opening' END, CASE WHEN t2 <> t3 THEN 'synonym' END, CASE WHEN t3 <> t4 THEN 'long sentence' END], lambda x: x IS NOT NULL) AS reasons
      FROM (SELECT *, CASE WHEN {split} THEN {_split_long('t3')} ELSE t3 END AS t4 FROM (SELECT *, CASE WHEN copied THEN {same} ELSE t2 END AS t3
      FROM (SELECT *, CASE WHEN styled AND o IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, styled, o ORDER BY idx) > 1 THEN substr(t1, length(o) + 1) ELSE t1 END AS t2
      FROM (SELECT *, {_opener('t1')} AS o FROM (SELECT *, CASE WHEN styled THEN {swap} ELSE text END AS t1
      FROM (SELECT r.doc_id, r.idx, r.start_pos, r.end_pos, r.text, r.kind, {styled} AS styled, {copied} AS copied FROM results r LEFT JOIN scores s USING (doc_id, start_pos)) WHERE styled OR copied))))))
      WHERE new <> '' AND new <> {trim('text')}"""


# the text before the last line that is a title of references; RE2 has no look-behind, so lines are counted
_STRIP = r"""SELECT doc_id, regexp_replace(body, '[ \t\n\x0B\f\r]+$', '') AS body FROM (SELECT DISTINCT doc_id, text, regexp_extract(text,
    '(?ms)\A(.*)^[ \t\n\x0B\f\r]*(?:参考文献|参[ \t\n\x0B\f\r]*考[ \t\n\x0B\f\r]*文[ \t\n\x0B\f\r]*献|致[ \t\n\x0B\f\r]*谢|References|REFERENCES|Bibliography)[ \t\n\x0B\f\r]*$', 1) AS body,
    regexp_matches(text, '(?ms)^[ \t\n\x0B\f\r]*(?:参考文献|参[ \t\n\x0B\f\r]*考[ \t\n\x0B\f\r]*文[ \t\n\x0B\f\r]*献|致[ \t\n\x0B\f\r]*谢|References|REFERENCES|Bibliography)[ \t\n\x0B\f\r]*$') AS has FROM documents WHERE text IS NOT NULL) WHERE has"""


def oracle_sql() -> dict[str, str]:
    trimmed = "regexp_replace({}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')"
    web_candidates = f"""SELECT doc_id, idx, place::INT AS place, kind, norm, units, CASE WHEN kind = 'zh' THEN substr(norm, 1, 16) ELSE array_to_string(list_slice(string_split(norm, ' '), 1, 10), ' ') END AS query
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY units DESC, idx) AS place FROM results WHERE NOT matched AND CASE WHEN kind = 'zh' THEN length(norm) >= {K.WEB_MIN_CHARS} ELSE units >= {K.WEB_MIN_WORDS} END) WHERE place <= {K.WEB_COUNT}"""
    out = {
        "library_scan": "SELECT doc_id, title, is_builtin, length(text)::INT AS chars FROM lib",
        "point_lookup": "SELECT DISTINCT id, title, content FROM library_docs WHERE id = 42",
        "inverted_abstract": "SELECT DISTINCT id AS doc_id, trim(regexp_replace(title, ' +', ' ', 'g')) AS text FROM library_docs WHERE title IS NOT NULL",
        "ingest_title_dedup": "SELECT doc_id, title FROM documents WHERE length(trim(title)) > 0 AND substr(trim(title), 1, 200) NOT IN (SELECT substr(trim(title), 1, 200) FROM library_docs WHERE title IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY substr(trim(title), 1, 200) ORDER BY doc_id) = 1",
        "upsert_latest": "SELECT DISTINCT id, CASE WHEN status = 'running' THEN 'stopped' ELSE status END AS status, fetched FROM crawl_jobs",
        "delete_user_docs": "SELECT doc_id, title, is_builtin FROM lib WHERE is_builtin = 1 OR doc_id NOT IN (SELECT id FROM library_docs WHERE origin = 'user')",
        "rate_bands": "SELECT id, total_rate, CASE WHEN total_rate < 10 THEN 'low' WHEN total_rate < 25 THEN 'middle' ELSE 'high' END AS band FROM (SELECT DISTINCT id, json_extract(report, '$.plagiarism.total_rate')::DOUBLE AS total_rate FROM checks WHERE report IS NOT NULL)",
        "report_reuse": "SELECT DISTINCT c.id, b.reused_id FROM checks c JOIN (SELECT doc_hash, params_hash, arg_max(id, {'f': finished_at, 'i': id}) AS reused_id FROM checks WHERE status = 'done' GROUP BY ALL) b USING (doc_hash, params_hash) WHERE c.id <> b.reused_id",
        "dedup_hash": f"SELECT doc_id, sha256({trimmed.format('text')}) AS doc_hash FROM lib",
        "recover_interrupted": "SELECT DISTINCT id, CASE WHEN status IN ('queued', 'running') THEN 'error' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN coalesce(error, 'interrupted') ELSE error END AS error FROM checks",
        "retention_purge": "SELECT id, status FROM (SELECT DISTINCT id, status, created_at FROM checks) WHERE created_at >= TIMESTAMP '2025-01-01' - INTERVAL 180 DAYS OR status IN ('queued', 'running')",
        "recent_jobs_top50": "SELECT id, source, status FROM (SELECT DISTINCT id, source, status, created_at FROM crawl_jobs) ORDER BY created_at DESC, id LIMIT 50",
        "library_listing": "SELECT DISTINCT id, title, is_builtin FROM library_docs",
        "detect_language": f"SELECT doc_id, {_kind('text')} AS kind FROM lib",
        "normalize_text": f"SELECT doc_id, {_norm('text', _kind('text'))} AS norm FROM lib",
        "split_sentences": "SELECT doc_id, idx, start_pos, end_pos, text FROM lib_all",
        "sentence_units": "SELECT doc_id, idx, kind, norm, units FROM lib_all",
        "sentence_shingles": f"SELECT doc_id, idx, unnest({_shingles('norm', 'kind', 'units')}) AS shingle FROM lib_all",
        "quoted_units": "SELECT doc_id, idx, quote_units AS quoted FROM lquoted",
        "word_count": "SELECT doc_id, length(replace(replace(text, ' ', ''), chr(10), ''))::INT AS words FROM lib",
        "simhash64": "SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint FROM prints",
        "phrase_density": f"SELECT item_id, {_phrases('text', _kind('text'), K.ZH_CONNECTORS, K.EN_CONNECTORS)} AS connectors, {_phrases('text', _kind('text'), K.ZH_CLICHES, K.EN_CLICHES)} AS cliches FROM aigc_eval",
        "web_query": "SELECT doc_id, idx, CASE WHEN kind = 'zh' THEN substr(norm, 1, 16) ELSE array_to_string(list_slice(string_split(norm, ' '), 1, 10), ' ') END AS query FROM lib_all",
        "rewrite_cliches": f"SELECT item_id, CASE WHEN {_kind('text')} = 'en' THEN {_fold('text', K.CLICHE_EN)} ELSE {_fold('text', K.CLICHE_ZH)} END AS new FROM aigc_eval",
        "rewrite_synonyms": f"SELECT item_id, CASE WHEN {_kind('text')} = 'en' THEN {_synonyms_en('text')} ELSE {_synonyms_zh('text')} END AS new FROM aigc_eval",
        "shingle_df": "SELECT shingle, df FROM df",
        "incremental_index": "SELECT shingle, df FROM df",
        "index_remove": "SELECT shingle, count(DISTINCT doc_id)::BIGINT AS df FROM lshx WHERE doc_id NOT IN (SELECT id FROM library_docs WHERE source_url IS NULL) GROUP BY shingle",
        "corpus_stats": "SELECT (SELECT count(*) FROM lib)::BIGINT AS documents, (SELECT sum(is_builtin) FROM lib)::BIGINT AS builtin_documents, count(*)::BIGINT AS sentences, coalesce(sum(units), 0)::BIGINT AS units FROM lsent",
        "recall_candidates": f"SELECT norm AS query, cnorm AS candidate, hits, {_round('containment', 6)} AS containment, {_round('coverage', 6)} AS coverage FROM cand",
        "blended_similarity": f"SELECT {_round('least(containment, 0.5 + 0.5 * coverage)', 4)} AS sim, count(*)::BIGINT AS pairs FROM cand GROUP BY 1",
        "find_similar_top3": "SELECT paper_id, idx, place, doc_id, sent_idx, sim FROM matches",
        "check_document": f"""SELECT *, CASE WHEN total_units > 0 THEN {_round("dup_units / total_units * 100", 1)} ELSE 0.0 END AS total_rate, CASE WHEN total_units > 0 THEN {_round("quote_units / total_units * 100", 1)} ELSE 0.0 END AS quote_rate
          FROM (SELECT doc_id, sum(units)::BIGINT AS total_units, sum(CASE WHEN matched AND NOT cited THEN units ELSE 0 END)::BIGINT AS dup_units,
            sum(CASE WHEN cited THEN units WHEN matched THEN least(quote_units, units) ELSE quote_units END)::BIGINT AS quote_units, count(*)::BIGINT AS sentence_count, sum(matched::INT)::BIGINT AS matched_sentences
          FROM (SELECT *, matched AND quote_units >= {K.QUOTE_SHARE} * greatest(units, 1) AS cited FROM results) GROUP BY doc_id)""",
        "source_totals": "SELECT doc_id, source_id, dup_units, hits, rate FROM sources",
        "source_counts": "SELECT paper_id, doc_id, count(*)::BIGINT AS hits FROM matches GROUP BY ALL",
        "source_variants": f"""SELECT doc_id, source_id, variant_id, hits FROM (SELECT s.doc_id, s.source_id, s.dup_units, c.doc_id AS variant_id, c.hits FROM sources s JOIN (SELECT paper_id, doc_id, count(*)::BIGINT AS hits FROM matches GROUP BY ALL) c ON c.paper_id = s.doc_id AND c.doc_id <> s.source_id
          JOIN prints a ON a.doc_id = s.source_id JOIN prints b ON b.doc_id = c.doc_id WHERE bit_count(xor(a.fp, b.fp)) <= {K.VARIANT_BITS}) QUALIFY row_number() OVER (PARTITION BY doc_id, variant_id ORDER BY dup_units DESC, source_id) = 1""",
        "fragments": f"""SELECT s.doc_id, s.fragment::BIGINT AS fragment, s.start_pos, s.end_pos, t.text, s.dup_units, {_round("s.dup_units / total_units * 100", 1)} AS rate, f.source_id, f.sim
          FROM spans s JOIN ftop f USING (doc_id, fragment) JOIN totals USING (doc_id) JOIN (SELECT r.doc_id, s.fragment, string_agg(r.text, '' ORDER BY r.idx) AS text FROM results r JOIN spans s ON s.doc_id = r.doc_id AND r.idx BETWEEN first_idx AND last_idx GROUP BY ALL) t USING (doc_id, fragment)""",
        "lm_counts": "SELECT g1, g2, g3, n FROM tri",
        "lm_sentence_stats": f"SELECT doc_id, idx, {_round('ppl', 5)} AS ppl, {_round('burst', 5)} AS burst, {_round('token_burst', 5)} AS token_burst FROM kept JOIN stats USING (kind, norm)",
        "lm_doc_burst": f"SELECT doc_id, {_round('ppl_cv', 5)} AS doc_burst FROM per WHERE ppls >= 3",
        "aigc_doc_score": f"SELECT doc_id, n, conn, cliche, types, tokens, marks, heads, {_round('len_cv', 6)} AS len_cv, doc_score FROM feats",
        "aigc_features": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, {_clamp(_round(_round(v, 6), 0), 5, 100)}::INT AS value FROM feats WHERE ({v}) IS NOT NULL" for n, v in _FEATURES.items()) + ")",
        "aigc_sentence_scores": "SELECT doc_id, idx, start_pos, end_pos, score, level FROM scores",
        "aigc_final": "SELECT doc_id, total_rate FROM final",
        "aigc_paragraphs": f"""SELECT doc_id, paragraph::BIGINT AS paragraph, min(start_pos) AS start_pos, max(end_pos) AS end_pos, {_round(_round("avg(score)", 9), 1)} AS rate, sum((level = 'high')::INT)::BIGINT AS high_count, count(*)::BIGINT AS sentences
          FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start_pos) AS paragraph FROM (SELECT *, coalesce((start_pos - lag(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos) > {K.PARAGRAPH_GAP})::INT, 0) AS new FROM scores)) GROUP BY doc_id, paragraph""",
        "web_candidates": web_candidates,
        "highlight_class": "SELECT r.doc_id, r.start_pos, CASE WHEN matched THEN 'dup' WHEN level = 'high' THEN 'machine' ELSE 'plain' END AS mark FROM results r LEFT JOIN scores s USING (doc_id, start_pos)",
        "engine_outcomes": """SELECT f.doc_id, engine, CASE WHEN kind = 'local' THEN 'ok' WHEN kind IN ('experimental', 'manual') THEN kind WHEN kind = 'external' THEN 'not_configured' WHEN p IS NULL THEN 'error' ELSE 'ok' END AS status,
          CASE WHEN kind = 'local' THEN total_rate WHEN kind = 'model' THEN floor(p * 1000 + 0.5) / 10 END AS rate
          FROM (SELECT f.doc_id, total_rate, CASE WHEN length(text) % 2 = 0 THEN floor(length(text) % 1000 / 1000 * 1000 + 0.5) / 1000 END AS p FROM final f JOIN paper USING (doc_id)) f,
          (VALUES ('local', 'local'), ('transformers', 'model'), ('watermark', 'experimental'), ('external-en', 'external'), ('external-zh', 'external'), ('manual', 'manual')) v(engine, kind)""",
        "machine_bands": "SELECT doc_id, total_rate, CASE WHEN total_rate < 30 THEN 'low' WHEN total_rate < 60 THEN 'middle' ELSE 'high' END AS band FROM final",
        "fragment_sources": """SELECT doc_id, fragment::BIGINT AS fragment, row_number() OVER (PARTITION BY doc_id, fragment ORDER BY hits DESC, met)::INT AS place, source_id, hits, sim
          FROM (SELECT h.doc_id, h.fragment, m.doc_id AS source_id, count(*)::BIGINT AS hits, max(m.sim) AS sim, min(h.idx * 10 + place) AS met FROM hit h JOIN matches m ON m.paper_id = h.doc_id AND m.idx = h.idx GROUP BY ALL)""",
        "simhash_pairs": f"SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM (SELECT fp, min(doc_id) AS id FROM prints GROUP BY fp) a JOIN (SELECT fp, min(doc_id) AS id FROM prints GROUP BY fp) b ON a.id < b.id WHERE bit_count(xor(a.fp, b.fp)) <= {K.VARIANT_BITS}",
        "simhash_classes": "SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS class_id FROM prints",
        "params_hash": """SELECT id, sha256('{"mode": "' || coalesce(json_extract_string(options_json, '$.mode'), 'full') || '", "strip_references": ' || coalesce(json_extract_string(options_json, '$.strip_references'), 'true')
          || ', "web_check": ' || coalesce(json_extract_string(options_json, '$.web_check'), 'false') || ', "web_check_count": ' || coalesce(json_extract_string(options_json, '$.web_check_count'), '10') || '}') AS params_hash FROM (SELECT DISTINCT * FROM checks)""",
        "submit_title": """SELECT doc_id, CASE WHEN length(trim(c.title)) > 0 THEN trim(c.title) WHEN length(text) % 3 = 0 THEN doc_id || '.v2' WHEN length(left(split_part(trim(text), chr(10), 1), 40)) > 0 THEN left(split_part(trim(text), chr(10), 1), 40) ELSE 'untitled' END AS title
          FROM paper JOIN (SELECT DISTINCT id AS doc_id, title FROM checks) c USING (doc_id)""",
        "url_guard": "SELECT DISTINCT id, CASE WHEN id % 5 <> 0 AND regexp_matches(source_url, '(?i)^https?://') THEN source_url ELSE '' END AS url FROM library_docs",
        "crawl_sources": "SELECT id, source, greatest(20, least(m, target_count))::INT AS target FROM (SELECT DISTINCT id, source, target_count FROM crawl_jobs) LEFT JOIN (VALUES ('arxiv', 5000), ('openalex-en', 20000), ('openalex-zh', 20000), ('doaj', 10000), ('europepmc', 10000)) v(source, m) USING (source)".replace("greatest(20, least(m, target_count))::INT", "CASE WHEN m IS NOT NULL THEN greatest(20, least(m, target_count)) ELSE 0 END::INT"),
        "harvest_jobs": """SELECT source, count(*)::BIGINT AS fetched, sum(new)::BIGINT AS added FROM (SELECT *, sum(1 - new) OVER (PARTITION BY source ORDER BY nth) - (1 - new) AS known FROM (
            SELECT *, CASE WHEN key NOT IN (SELECT left(trim(title), 200) FROM library_docs WHERE title IS NOT NULL) AND row_number() OVER (PARTITION BY source, key ORDER BY nth) = 1 THEN 1 ELSE 0 END AS new FROM (
              SELECT source, left(trim(title), 200) AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents WHERE length(trim(title)) > 0 QUALIFY nth <= 200))) WHERE known <= 20 GROUP BY source""",
        "job_errors": """SELECT source, left(string_agg(message, '; ' ORDER BY nth DESC), 400) AS tail FROM (SELECT source, message, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) AS nth
            FROM (SELECT DISTINCT source, created_at, id, message FROM crawl_jobs WHERE message IS NOT NULL) QUALIFY nth <= 2) GROUP BY source""",
        "library_parts": "SELECT doc_id, CASE WHEN is_builtin = 1 THEN 'builtin' ELSE 'user' END AS part FROM lib",
        "check_listing": "SELECT id, title, status FROM (SELECT DISTINCT id, title, status, created_at FROM checks)",
        "stage_progress": "SELECT id, CASE status WHEN 'done' THEN 100 WHEN 'error' THEN 100 ELSE 0 END AS percent FROM (SELECT DISTINCT * FROM checks)",
        "strip_references": _STRIP,
        "html_extract": r"SELECT doc_id, trim(regexp_replace(text || ' ©', '[ \t\n\r\f\x{A0}]+', ' ', 'g')) AS text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)",
        "strip_tags": r"SELECT doc_id, regexp_replace(title || ' &lt; €€', '^[ \t\n\x0B\f\r]+', '') AS title FROM lib",
        "audit_json": """SELECT id, '{"ts":"' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '","event":"' || status || '"' || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || to_json(left(title, 40))::VARCHAR END || '}' AS line FROM (SELECT DISTINCT * FROM checks)""",
        "corpus_state_hash": "SELECT count(*)::BIGINT AS documents, sha256(count(*)::VARCHAR || '|' || sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT::VARCHAR || '|' || sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT::VARCHAR || '|' || sum(('0x' || substr(h, 31, 15))::BIGINT)::HUGEINT::VARCHAR) AS state FROM (SELECT sha256(doc_id || '|' || coalesce(title, '') || '|' || sha256(coalesce(text, ''))) AS h FROM lib)",
        "doc_title": "SELECT doc_id, CASE WHEN length(f) > 0 THEN f ELSE 'untitled' END AS from_text, CASE WHEN length(trim(title)) > 0 THEN left(trim(title), 120) WHEN length(f) > 0 THEN f ELSE 'untitled' END AS given FROM (SELECT doc_id, title, left(split_part(trim(text), chr(10), 1), 60) AS f FROM lib)",
        "rewrite_long_split": f"SELECT doc_id, idx, new FROM (SELECT *, {_split_long('text')} AS new FROM lib_all) WHERE new <> text",
        "rewrite_segments": " UNION ALL ".join(f"SELECT doc_id, '{m}' AS mode, idx, new, array_to_string(reasons, ', ') AS reasons FROM ({_edits(m)})" for m in ("dedup", "humanize", "both")),
        "rewrite_full": f"""SELECT p.doc_id, coalesce(string_agg(substr(p.text, from_ + 1, start_pos - from_) || new, '' ORDER BY start_pos), '') || substr(p.text, coalesce(max(end_pos), 0) + 1) AS text
          FROM paper p LEFT JOIN (SELECT *, coalesce(lag(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), 0) AS from_ FROM ({_edits("both")})) e USING (doc_id) GROUP BY p.doc_id, p.text""",
        "sliding_events": "SELECT strftime(date_trunc('hour', ts) - to_hours(k), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS events FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL",
        "session_events": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
            SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
        "rate_attempts": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS attempts FROM events",
        "progress_changes": "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
        "progress_live": "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-15' - INTERVAL 86400 SECONDS",
        "hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*)::BIGINT AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    }
    out = {name: _with(sql) for name, sql in out.items()}
    items = _sentences("(SELECT item_id AS doc_id, text FROM aigc_eval)")
    out["thin_connectors"] = f"WITH s AS ({items}), o AS (SELECT *, {_opener('text')} AS opener FROM s) SELECT doc_id, idx, CASE WHEN opener IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, opener ORDER BY idx) > 1 THEN substr(text, length(opener) + 1) ELSE text END AS thinned FROM o"
    evals = {
        "eval_scores": "SELECT doc_id, lang, label, score FROM scored",
        "auroc": f"SELECT lang, {_round('won / (p * n)', 6)} AS auroc FROM (SELECT lang, sum(r * label) - sum(label) * (sum(label) + 1) / 2 AS won, sum(label) AS p, sum(1 - label) AS n FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM twice) GROUP BY lang)",
        "f1_sweep": "SELECT lang, threshold, precision, recall, f1, fpr FROM rated",
        "eval_gates": f"SELECT 'auroc' AS gate, auroc AS value, 0.8::DOUBLE AS bound, auroc >= 0.8 AS passed FROM area WHERE lang = 'all' UNION ALL SELECT 'fpr_at_45', fpr, 0.4::DOUBLE, fpr <= 0.4 FROM rated WHERE lang = 'all' AND threshold = 45",
        "best_f1": "SELECT lang, threshold, f1 FROM rated QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold) = 1",
        "eval_by_lang": f"SELECT coalesce(lang, 'all') AS lang, label, count(*)::BIGINT AS items, {_round('avg(score)', 4)} AS mean_score FROM scored GROUP BY GROUPING SETS ((lang, label), (label))",
    }
    out |= {name: _with(sql, **_EVAL) for name, sql in evals.items()}
    # rules that look back on their own outcomes, as recursive steps from one row of a group to the next
    out["chunk_pack"] = _with(
        "SELECT doc_id, chunk, sum(units)::BIGINT AS units, count(*)::INT AS sentences FROM packed GROUP BY doc_id, chunk",
        packed=f"""SELECT doc_id, idx, units, units AS held, 0 AS chunk FROM lib_all WHERE idx = 0 UNION ALL
          SELECT s.doc_id, s.idx, s.units, CASE WHEN held + s.units > {K.CHUNK_UNITS} THEN s.units ELSE held + s.units END, CASE WHEN held + s.units > {K.CHUNK_UNITS} THEN chunk + 1 ELSE chunk END
          FROM packed p JOIN lib_all s ON s.doc_id = p.doc_id AND s.idx = p.idx + 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    events = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
    fresh = "list_filter(log, lambda x: e.t - x < 86400000000)"
    out["rate_limiter"] = f"""WITH RECURSIVE {events}, r AS (SELECT user_id, event_id, nth, [t] AS log, 1 AS admitted FROM e WHERE nth = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.nth, CASE WHEN len({fresh}) < 3 THEN list_append({fresh}, e.t) ELSE {fresh} END, (len({fresh}) < 3)::INT FROM r JOIN e ON e.user_id = r.user_id AND e.nth = r.nth + 1)
      SELECT user_id, event_id, admitted FROM r"""
    recent = f"list_append(list_filter(fails, lambda x: e.t - x < {K.FAIL_WINDOW_S}000000), e.t)"
    banned = f"len({recent}) >= {K.FAIL_LIMIT}"
    out["auth_bans"] = f"""WITH RECURSIVE {events}, r AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS nth, []::BIGINT[] AS fails, 0::BIGINT AS until, '' AS state FROM e WHERE nth = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.nth,
        CASE WHEN e.t < until THEN fails WHEN event_type = 'signup' THEN [] WHEN event_type <> 'error' THEN fails WHEN {banned} THEN [] ELSE {recent} END,
        CASE WHEN e.t >= until AND event_type = 'error' AND {banned} THEN e.t + {K.BAN_S}000000 ELSE until END,
        CASE WHEN e.t < until THEN 'banned' WHEN event_type = 'signup' THEN 'ok' WHEN event_type = 'error' THEN 'failed' ELSE 'none' END
      FROM r JOIN e ON e.user_id = r.user_id AND e.nth = r.nth + 1) SELECT user_id, event_id, state FROM r WHERE nth > 0"""
    least = f"CASE WHEN kind = 'zh' THEN {K.ZH_SIM_THRESHOLD} ELSE {K.EN_SIM_THRESHOLD} END"
    out["web_verify"] = _with(
        f"""SELECT doc_id, page_id, sum(units)::BIGINT AS units, count(*)::BIGINT AS hits, {_round("sum(units) / greatest(any_value(total_units), 1) * 100", 1)} AS rate
          FROM (SELECT c.doc_id, c.idx, c.units, w.page_id, total_units FROM wanted c JOIN wbest w USING (kind, norm) JOIN totals USING (doc_id)
            QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.idx ORDER BY w.sim DESC, w.page_id) = 1) GROUP BY doc_id, page_id""",
        wanted=web_candidates,
        pages=f"SELECT DISTINCT doc_id, substr(text, 1, {K.WEB_PAGE_CHARS}) AS text FROM documents WHERE text IS NOT NULL",
        psents=_sentences("(SELECT doc_id, text FROM pages)"),
        wsh=f"SELECT kind, norm, len(sh) AS nq, unnest(sh) AS shingle FROM (SELECT kind, norm, {_shingles('norm', 'kind', 'units', 4)} AS sh FROM (SELECT DISTINCT kind, norm, units FROM wanted))",
        psh=f"SELECT page_id, idx, kind, len(sh) AS nc, unnest(sh) AS shingle FROM (SELECT doc_id AS page_id, idx, kind, {_shingles('norm', 'kind', 'units')} AS sh FROM psents WHERE units >= 6)",
        wmet="SELECT q.kind, q.norm, p.page_id, p.idx, count(*) / least(any_value(nq), any_value(nc)) AS s FROM wsh q JOIN psh p ON q.kind = p.kind AND q.shingle = p.shingle GROUP BY ALL",
        whole_pages=f"SELECT doc_id AS page_id, kind, {_norm('text', 'kind')} AS page_norm FROM pages, (VALUES ('zh'), ('en')) v(kind)",
        wbest=f"""SELECT kind, norm, page_id, max(sim) AS sim FROM (SELECT kind, norm, page_id, {_round('s', 4)} AS sim FROM wmet WHERE {_round('s', 4)} >= {least} UNION ALL
          SELECT q.kind, q.norm, page_id, 1.0 FROM (SELECT DISTINCT kind, norm FROM wanted WHERE length(norm) >= {K.WEB_MIN_CHARS}) q JOIN whole_pages w ON q.kind = w.kind AND contains(page_norm, q.norm)) GROUP BY ALL""",
    )
    return out
