"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import aigc, chunks, engines, evaluate, index, lm, overlap, records, report, rewrite, web
from ..session import stored, table
from ..sources import harvest
from ..streaming import stateful
from .check import Check, library, papers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return library(table(spark, sf, "library_docs").select("id", "title", "content", "is_builtin"))


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return papers(table(spark, sf, "checks").select("id", "report"))


def _check(spark: SparkSession, sf: str) -> Check:
    c = Check(_docs(spark, sf), _papers(spark, sf))
    c.again = False
    return c


def _sents(spark: SparkSession, sf: str) -> DataFrame:
    return index.sentences(_docs(spark, sf))


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "checks").distinct()


# ---- sources and records ----


@query
def library_scan(spark, sf):
    return _docs(spark, sf).select("doc_id", "title", "is_builtin", F.length("text").alias("chars"))


@query
def point_lookup(spark, sf):
    return table(spark, sf, "library_docs").where("id = 42").select("id", "title", "content").distinct()


@query
def strip_references(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL")
    body = T.strip_references(F.col("text"))
    return docs.select("doc_id", F.regexp_replace(body, r"[ \t\n\x0B\f\r]+$", "").alias("body")).where(body != F.col("text"))


@query
def html_extract(spark, sf):
    page = F.concat(F.lit("<html><head><title>x</title></head><body><script>var a;</script><p>"), T.escape_html(F.col("text")), F.lit("</p> &copy;</body></html>"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", page.alias("html"))
    return docs.select("doc_id", T.html_text(F.col("html")).alias("text"))


@query
def strip_tags(spark, sf):
    t = F.concat(F.lit(" <b>"), T.escape_html(F.col("title")), F.lit("</b> <i class='x'>&amp;lt; &#8364;&#x20AC;</i>"))
    return _docs(spark, sf).select("doc_id", T.strip_tags(t).alias("title"))


@query
def inverted_abstract(spark, sf):
    """Titles turned into word → positions and put together again."""
    words = F.split(F.trim(F.regexp_replace("title", " +", " ")), " ")
    each = table(spark, sf, "library_docs").where("title IS NOT NULL").select(F.col("id").alias("doc_id"), "title").distinct().select("doc_id", F.posexplode(words).alias("place", "word"))
    maps = each.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("place")).alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return records.rebuild_abstract(maps)


@query
def ingest_title_dedup(spark, sf):
    """Documents whose title the library does not have yet."""
    incoming = table(spark, sf, "documents").select("doc_id", "title").where("title IS NOT NULL")
    return records.ingest(incoming, table(spark, sf, "library_docs").where("title IS NOT NULL").select("title"))


@query
def upsert_latest(spark, sf):
    """Jobs with changes of the first day merged in."""
    jobs = table(spark, sf, "crawl_jobs").select("id", "status", "fetched", "updated_at").distinct()
    changes = jobs.where("status = 'running'").withColumn("status", F.lit("stopped")).withColumn("updated_at", F.lit("2030-01-01").cast("timestamp_ntz"))
    return records.upsert(jobs, changes, ["id"], "updated_at").select("id", "status", "fetched")


@query
def delete_user_docs(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "title", "is_builtin")
    gone = table(spark, sf, "library_docs").where("origin = 'user'").select(F.col("id").alias("doc_id")).distinct()
    return records.delete_user_documents(docs, gone)


@query
def rate_bands(spark, sf):
    total = F.get_json_object("report", "$.plagiarism.total_rate").cast("double")
    rows = _checks(spark, sf).where("report IS NOT NULL").select("id", total.alias("total_rate"))
    return rows.select("id", "total_rate", report.rate_band("total_rate").alias("band"))


@query
def audit_json(spark, sf):
    rows = _checks(spark, sf)
    return rows.select("id", records.audit_line(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.col("status"), F.col("title")).alias("line"))


@query
def corpus_state_hash(spark, sf):
    return index.state_hash(_docs(spark, sf))


@query
def dedup_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", records.text_key(F.col("text")).alias("doc_hash"))


@query
def report_reuse(spark, sf):
    rows = table(spark, sf, "checks").select("id", "status", "doc_hash", "params_hash", "finished_at").distinct()
    return records.report_reuse(rows, rows)


@query
def recover_interrupted(spark, sf):
    return records.recover_interrupted(table(spark, sf, "checks").select("id", "status", "error").distinct())


@query
def retention_purge(spark, sf):
    rows = table(spark, sf, "checks").select("id", "status", "created_at").distinct()
    return records.purge(rows, F.lit("2025-01-01").cast("timestamp_ntz"), 180).select("id", "status")


@query
def recent_jobs_top50(spark, sf):
    return table(spark, sf, "crawl_jobs").select("id", "source", "status", "created_at").distinct().orderBy(F.desc("created_at"), "id").limit(50).select("id", "source", "status")


@query
def library_listing(spark, sf):
    """Documents by builtin first, then newest."""
    rows = table(spark, sf, "library_docs").select("id", "title", "is_builtin", "created_at").distinct()
    return rows.orderBy(F.desc("is_builtin"), F.desc("created_at"), "id").select("id", "title", "is_builtin")


# ---- text scalars ----


@query
def detect_language(spark, sf):
    return _docs(spark, sf).select("doc_id", T.detect_language(F.col("text")).alias("kind"))


@query
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize(F.col("text"), T.detect_language(F.col("text"))).alias("norm"))


@query
def split_sentences(spark, sf):
    return _sents(spark, sf).select("doc_id", "idx", "start_pos", "end_pos", "text")


@query
def sentence_units(spark, sf):
    return _sents(spark, sf).select("doc_id", "idx", "kind", "norm", "units")


@query
def sentence_shingles(spark, sf):
    return index.explode_shingles(index.with_shingles(_sents(spark, sf)), "doc_id", "idx")


@query
def quoted_units(spark, sf):
    return _sents(spark, sf).select("doc_id", "idx", T.quoted_units(F.col("text"), F.col("kind")).alias("quoted"))


@query
def word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query
def doc_title(spark, sf):
    return _docs(spark, sf).select("doc_id", T.short_title(F.col("text")).alias("from_text"), T.short_title(F.col("text"), F.col("title")).alias("given"))


@query
def simhash64(spark, sf):
    prints = index.simhash(_docs(spark, sf))
    return prints.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"))


@query
def phrase_density(spark, sf):
    zh = T.detect_language(F.col("text")) == "zh"
    low = F.lower("text")
    conn = F.when(zh, T.phrase_hits(F.col("text"), K.ZH_CONNECTORS)).otherwise(T.phrase_hits(low, K.EN_CONNECTORS))
    cliche = F.when(zh, T.phrase_hits(F.col("text"), K.ZH_CLICHES)).otherwise(T.phrase_hits(low, K.EN_CLICHES))
    return table(spark, sf, "aigc_eval").select("item_id", conn.alias("connectors"), cliche.alias("cliches"))


@query
def web_query(spark, sf):
    return _sents(spark, sf).select("doc_id", "idx", web.web_query(F.col("norm"), F.col("kind")).alias("query"))


@query
def rewrite_cliches(spark, sf):
    rows = table(spark, sf, "aigc_eval").select("item_id", rewrite.swap_cliches(F.col("text"), T.detect_language(F.col("text"))).alias("new"))
    return rows


@query
def rewrite_synonyms(spark, sf):
    return table(spark, sf, "aigc_eval").select("item_id", rewrite.swap_synonyms(F.col("text"), T.detect_language(F.col("text"))).alias("new"))


@query
def rewrite_long_split(spark, sf):
    s = _sents(spark, sf)
    new = rewrite.split_long(F.col("text"), F.col("kind"))
    return s.select("doc_id", "idx", new.alias("new")).where(new != F.col("text"))


@query
def thin_connectors(spark, sf):
    items = table(spark, sf, "aigc_eval").select(F.col("item_id").alias("doc_id"), "text")
    return rewrite.thin_connectors(index.sentences(items)).select("doc_id", "idx", "thinned")


@query
def chunk_pack(spark, sf):
    return chunks.pack(_sents(spark, sf))


# ---- index and similarity ----


@query
def shingle_df(spark, sf):
    """Sentences that a library does not keep have no shingle, so none is left out before."""
    return index.doc_frequency(index.with_shingles(_sents(spark, sf)))


@query
def corpus_stats(spark, sf):
    docs = stored(_docs(spark, sf))
    return index.corpus_stats(docs, index.library_sentences(index.sentences(docs)))


@query
def index_remove(spark, sf):
    """Document frequencies when every document without a source address has left."""
    shingled = stored(index.with_shingles(index.library_sentences(_sents(spark, sf))).select("doc_id", "shingles"))
    gone = table(spark, sf, "library_docs").where("source_url IS NULL").select(F.col("id").alias("doc_id")).distinct()
    return index.remove_documents(index.doc_frequency(shingled), shingled, gone)


@query
def recall_candidates(spark, sf):
    """Pairs of equal-norm sentence classes that share shingles, with the sizes they agree in."""
    c = _check(spark, sf)
    return overlap.listed(c.sentences, index.library_sentences(index.sentences(c.library)), c.library)


@query
def blended_similarity(spark, sf):
    c = _check(spark, sf)
    return overlap.similarities(c.sentences, index.library_sentences(index.sentences(c.library)), c.library)


@query
def find_similar_top3(spark, sf):
    return _check(spark, sf).matches


@query
def check_document(spark, sf):
    return _check(spark, sf).rates


@query
def source_totals(spark, sf):
    return _check(spark, sf).sources


@query
def source_counts(spark, sf):
    return report.source_counts(_check(spark, sf).matches)


@query
def source_variants(spark, sf):
    return _check(spark, sf).variants


@query
def fragments(spark, sf):
    return _check(spark, sf).fragments


@query
def incremental_index(spark, sf):
    """Document frequencies from two parts of the library added up."""
    s = stored(index.with_shingles(index.library_sentences(_sents(spark, sf))).select("doc_id", "shingles"))
    parts = [index.doc_frequency(s.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("shingle").agg(F.sum("df").alias("df"))


# ---- language model and machine-text score ----


@query
def lm_counts(spark, sf):
    toks = lm.library_tokens(index.library_sentences(_sents(spark, sf)))
    return lm.ngrams(toks, 3).select("g1", "g2", "g3", "n")


@query
def lm_sentence_stats(spark, sf):
    c = _check(spark, sf)
    s = c.kept.select("doc_id", "idx", index.norm_id(F.col("kind"), F.col("norm")).alias("sid"))
    r = lambda x: T.rounded(F.col(x), 5).alias(x)
    return s.join(c.smoothness, "sid").select("doc_id", "idx", r("ppl"), r("burst"), r("token_burst"))


@query
def lm_doc_burst(spark, sf):
    c = _check(spark, sf)
    return lm.doc_burst(c.kept, c.smoothness).select("doc_id", T.rounded(F.col("doc_burst"), 5).alias("doc_burst"))


@query
def aigc_doc_score(spark, sf):
    f = _check(spark, sf).features
    return f.select("doc_id", "n", "conn", "cliche", "types", "tokens", "marks", "heads", T.rounded(F.col("len_cv"), 6).alias("len_cv"), "doc_score")


@query
def aigc_features(spark, sf):
    return aigc.feature_rows(_check(spark, sf).features)


@query
def aigc_sentence_scores(spark, sf):
    return _check(spark, sf).sentence_scores


@query
def aigc_final(spark, sf):
    return _check(spark, sf).machine_rates


@query
def aigc_paragraphs(spark, sf):
    return aigc.paragraphs(_check(spark, sf).sentence_scores)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """(lang, label, score) of the labelled evaluation items."""
    items = table(spark, sf, "aigc_eval").distinct().where("text IS NOT NULL")
    c = Check(_docs(spark, sf), items.select(F.col("item_id").alias("doc_id"), "text"), strip=False)
    own = items.select(F.col("item_id").alias("doc_id"), "lang", (F.col("label") == "ai").cast("int").alias("label"))
    return stored(own.join(c.machine_rates, "doc_id").select("doc_id", "lang", "label", F.col("total_rate").alias("score")))


@query
def eval_scores(spark, sf):
    return _scored(spark, sf)


@query
def auroc(spark, sf):
    return evaluate.auroc(evaluate.with_all(_scored(spark, sf), "lang"), "lang")


@query
def f1_sweep(spark, sf):
    return evaluate.sweep(evaluate.with_all(_scored(spark, sf), "lang"), "lang")


@query
def best_f1(spark, sf):
    return evaluate.best_threshold(evaluate.sweep(evaluate.with_all(_scored(spark, sf), "lang"), "lang"), "lang")


@query
def eval_by_lang(spark, sf):
    """Mean scores by label, for each language and over all, by grouping sets."""
    s = _scored(spark, sf)
    return s.groupingSets([["lang", "label"], ["label"]], "lang", "label").agg(F.count("*").alias("items"), T.rounded(F.avg("score"), 4).alias("mean_score")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "label", "items", "mean_score")


# ---- pipelines ----


@query
def web_candidates(spark, sf):
    return web.web_candidates(_check(spark, sf).results)


@query
def web_verify(spark, sf):
    """Unmatched sentences of papers looked up in the texts of ``documents`` as pages."""
    scan = table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pages = scan.repartition(parts, "doc_id").distinct()
    return _check(spark, sf).web(pages)


@query
def highlight_class(spark, sf):
    """What marks a sentence in the report: duplicated before machine-styled."""
    c = _check(spark, sf)
    s = c.results.select("doc_id", "start_pos", "matched").join(c.sentence_scores.select("doc_id", "start_pos", "level"), ["doc_id", "start_pos"], "left")
    mark = F.when(F.col("matched"), "dup").when(F.col("level") == "high", "machine").otherwise("plain")
    return s.select("doc_id", "start_pos", mark.alias("mark"))


@query
def rewrite_full(spark, sf):
    c = _check(spark, sf)
    return c.rewritten(c.edits())


@query
def rewrite_delta(spark, sf):
    """Both rates before and after rewriting, in each mode."""
    c = _check(spark, sf)
    parts = [c.rewrite_delta(mode) for mode in rewrite.MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def full_report(spark, sf):
    return _check(spark, sf).full_report()


@query
def report_html(spark, sf):
    return _check(spark, sf).html_report()


@query
def engine_outcomes(spark, sf):
    """Every engine's outcome per paper; the model engine answers for papers with an even number of characters, and fails for the others."""
    c = _check(spark, sf)
    answers = c.papers.select("doc_id", F.when(F.length("text") % 2 == 0, T.rounded(F.length("text") % 1000 / 1000.0, 3)).alias("probability"))
    return engines.outcomes(c.machine_rates, model=answers).select("doc_id", "engine", "status", "rate")


@query
def machine_bands(spark, sf):
    return _check(spark, sf).machine_rates.select("doc_id", "total_rate", report.machine_band("total_rate").alias("band"))


@query
def fragment_sources(spark, sf):
    c = _check(spark, sf)
    return report.fragment_sources(c.results, c.matches)


@query
def simhash_pairs(spark, sf):
    """Pairs of classes of near fingerprints; ``simhash_classes`` has the members."""
    return index.simhash_pairs(stored(index.simhash(_docs(spark, sf))))


@query
def simhash_classes(spark, sf):
    return index.simhash_classes(stored(index.simhash(_docs(spark, sf))))


@query
def eval_gates(spark, sf):
    s = evaluate.with_all(_scored(spark, sf), "lang")
    return evaluate.gates(evaluate.auroc(s, "lang"), evaluate.sweep(s, "lang"), "lang")


@query
def params_hash(spark, sf):
    return _checks(spark, sf).select("id", records.params_key(F.col("options_json")).alias("params_hash"))


@query
def submit_title(spark, sf):
    """Titles of papers as submitted: given, from a file's name, or from the text."""
    rows = _papers(spark, sf).join(_checks(spark, sf).select(F.col("id").alias("doc_id"), "title").distinct(), "doc_id")
    file = F.when(F.length("text") % 3 == 0, F.concat(F.lit("/up/"), "doc_id", F.lit(".v2.docx")))
    return rows.select("doc_id", T.submit_title(F.col("text"), F.col("title"), file).alias("title"))


@query
def url_guard(spark, sf):
    rows = table(spark, sf, "library_docs").select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("ftp://"), "source_url")).otherwise(F.col("source_url")).alias("url")).distinct()
    return rows.select("id", T.safe_url(F.col("url")).alias("url"))


@query
def crawl_sources(spark, sf):
    """Harvest jobs with their target within the limits of their source."""
    jobs = table(spark, sf, "crawl_jobs").select("id", "source", "target_count").distinct()
    return harvest.clamped(jobs, harvest.sources(spark)).select("id", "source", F.coalesce("target", F.lit(0)).alias("target"))


@query
def harvest_jobs(spark, sf):
    """One harvest of at most 200 documents per source, ended after 20 known titles."""
    library = table(spark, sf, "library_docs").where("title IS NOT NULL").select("title")
    return records.harvest(table(spark, sf, "documents").where("title IS NOT NULL"), library, 200, 20)


@query
def job_errors(spark, sf):
    """The last messages of every source's jobs."""
    jobs = table(spark, sf, "crawl_jobs").where("message IS NOT NULL").select("source", "created_at", "id", "message").distinct()
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("created_at"), F.desc("id")))
    last = jobs.withColumn("nth", newest).where("nth <= 2").groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("nth")).alias("n"), "message"))).alias("m"))
    return last.select("source", records.error_tail(F.transform("m", lambda x: x["message"])).alias("tail"))


@query
def library_parts(spark, sf):
    return _docs(spark, sf).select("doc_id", records.library_part(F.col("is_builtin")).alias("part"))


@query
def check_listing(spark, sf):
    """Checks, newest first."""
    return _checks(spark, sf).select("id", "title", "status", "created_at").distinct().orderBy(F.desc("created_at"), "id").select("id", "title", "status")


@query
def stage_progress(spark, sf):
    return _checks(spark, sf).select("id", F.coalesce(stateful.stage_percent(F.col("status")), F.lit(0)).alias("percent"))


@query
def rewrite_segments(spark, sf):
    """Changed sentences in each mode, with the reasons."""
    c = _check(spark, sf)
    out = None
    for mode in rewrite.MODES:
        part = c.edits(mode).select("doc_id", F.lit(mode).alias("mode"), "idx", "new", F.array_join("reasons", ", ").alias("reasons"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- event streams ----


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query
def rate_limiter(spark, sf):
    """Admission of each event at 3 requests in a day per client."""
    return stateful.limiter(_events(spark, sf), 3, 86_400).select("user_id", "event_id", F.col("admitted").cast("int").alias("admitted"))


@query
def rate_attempts(spark, sf):
    return stateful.attempts(_events(spark, sf), 86_400)


@query
def auth_bans(spark, sf):
    return stateful.bans(_events(spark, sf)).select("user_id", "event_id", "state")


@query
def progress_changes(spark, sf):
    return stateful.progress_changes(_events(spark, sf))


@query
def progress_live(spark, sf):
    return stateful.live_progress(_events(spark, sf), "2024-01-15 00:00:00", 86_400)


@query
def hourly_events(spark, sf):
    return stateful.hourly(_events(spark, sf)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query
def sliding_events(spark, sf):
    return stateful.sliding(_events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query
def session_events(spark, sf):
    return stateful.sessions(_events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
