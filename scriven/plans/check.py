"""The composite pipelines: document check, machine-text analysis, web verification, rewriting, full report."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aigc, engines, index, lm, overlap, report, rewrite, similarity, web
from ..session import alone, by_key, drop, stored

#: Fields of a stored check report that hold the submitted text.
REPORT = "plagiarism STRUCT<sent_results: ARRAY<STRUCT<text: STRING>>>"


def library(rows: DataFrame) -> DataFrame:
    """(doc_id, title, text, is_builtin) of library rows: re-delivered rows are one, null texts leave."""
    picked = rows.select(F.col("id").alias("doc_id"), "title", F.col("content").alias("text"), "is_builtin")
    return by_key(picked.where("text IS NOT NULL"), "doc_id")


def papers(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of the texts submitted in reports: their sentences in order, parted by a blank."""
    said = F.from_json("report", REPORT)["plagiarism"]["sent_results"]
    text = F.array_join(F.transform(said, lambda s: s["text"]), " ")
    return by_key(rows.where("report IS NOT NULL").select(F.col("id").alias("doc_id"), text.alias("text")), "doc_id").where("text IS NOT NULL")


class Check:
    """Every table of a check of ``papers`` (doc_id, text) against a ``library`` (doc_id, title, text, is_builtin).

    Tables are lazy; those that several others read are written once to the
    shared folder. With ``strip`` reference sections of papers are left out of
    the similarity check; the machine-text score always reads the whole text.
    """

    def __init__(self, library: DataFrame, papers: DataFrame, strip: bool = True, tables: dict[str, DataFrame] | None = None):
        """``tables`` is a ``snapshot`` of the library: its sentences and model are then read, not made."""
        self.library, self.papers, self.strip, self.tables = library, papers, strip, tables
        self.again = True  # may the library be matched once more?

    @cached_property
    def library_sentences(self) -> DataFrame:
        return self.tables["sentences"] if self.tables else stored(index.library_sentences(index.sentences(self.library)).select("doc_id", "idx", "kind", "norm", "units"))

    @cached_property
    def digested(self) -> DataFrame:
        """The library's sentences with their shingles' digests, written in one pass where there are no sentences yet: they come by documents."""
        if self.tables or "library_sentences" in self.__dict__:
            return overlap.digested(self.library_sentences)
        made = stored(overlap.with_digests(index.library_sentences(index.sentences(self.library))))
        self.library_sentences = made.drop("shingles")
        return made

    @cached_property
    def sentences(self) -> DataFrame:
        body = self.papers.withColumn("text", T.strip_references(F.col("text"))) if self.strip else self.papers
        return stored(report.quoted(index.sentences(body)))

    @cached_property
    def matches(self) -> DataFrame:
        held = self.digested  # first, as it makes the library's sentences too
        return stored(similarity.find_similar(self.sentences, self.library_sentences, self.library, held))

    def release(self) -> None:
        """The library's digests go, which take most of the disk, when matches are there; asked for again, they are made again."""
        if not self.again and not self.tables and "matches" in self.__dict__ and (held := self.__dict__.pop("digested", None)) is not None:
            self.library_sentences = stored(held.select("doc_id", "idx", "kind", "norm", "units"))
            drop(held)

    @cached_property
    def results(self) -> DataFrame:
        """Not written: what reads it takes few columns, and the sentences are stored."""
        return report.sentence_results(self.sentences, self.matches)

    @cached_property
    def rates(self) -> DataFrame:
        return report.rates(self.results)

    @cached_property
    def fragments(self) -> DataFrame:
        return report.fragments(self.results, self.sentences)

    @cached_property
    def sources(self) -> DataFrame:
        return report.source_totals(self.results)

    @cached_property
    def variants(self) -> DataFrame:
        met = self.matches.select("doc_id").distinct()
        self.release()
        prints = index.simhash(self.library.join(met, "doc_id", "left_semi"))
        return report.source_variants(self.sources, report.source_counts(self.matches), stored(prints))

    @cached_property
    def model(self) -> lm.Model:
        self.release()
        return lm.Model(self.library_sentences, self.tables, whole=True)

    @cached_property
    def whole_sentences(self) -> DataFrame:
        return stored(report.quoted(index.sentences(self.papers))) if self.strip else self.sentences

    @cached_property
    def smoothness(self) -> DataFrame:
        return stored(self.model.sentence_stats(aigc.kept_sentences(self.whole_sentences, self.papers)))

    @cached_property
    def kept(self) -> DataFrame:
        return aigc.kept_sentences(self.whole_sentences, self.papers)

    @cached_property
    def features(self) -> DataFrame:
        return stored(aigc.document_features(self.papers, self.kept, self.smoothness))

    @cached_property
    def sentence_scores(self) -> DataFrame:
        return stored(aigc.sentence_scores(self.kept, self.smoothness))

    @cached_property
    def machine_rates(self) -> DataFrame:
        return aigc.final_scores(self.papers, self.features, self.sentence_scores)

    @cached_property
    def unstripped(self) -> Check:
        """The same check without leaving reference sections out: rewriting measures and changes whole texts."""
        if not self.strip:
            return self
        other = Check(self.library, self.papers, strip=False)
        other.digested, other.library_sentences, other.sentences = self.digested, self.library_sentences, self.whole_sentences
        other.again = self.again
        other.matches  # before the model, for which the digests go
        if not self.again:
            other.release()
            del self.digested
            self.library_sentences = other.library_sentences
        other.model = self.model
        other.smoothness, other.sentence_scores = self.smoothness, self.sentence_scores
        return other

    def edits(self, mode: str = "both") -> DataFrame:
        c = self.unstripped
        return stored(rewrite.rewrite(c.sentences, c.results, c.sentence_scores, mode))

    def rewritten(self, edits: DataFrame) -> DataFrame:
        return rewrite.full_text(self.papers, edits)

    def rewrite_delta(self, mode: str = "both") -> DataFrame:
        """(doc_id, mode, changed, before and after of the rates the mode is about): before and after are measured alike."""
        self.again = True
        c = self.unstripped
        # tables that several modes read are made here: what a mode makes goes with it
        c.matches, c.digested, c.smoothness, c.sentence_scores
        if mode != "dedup":
            c.features
        return alone(self.papers.sparkSession, lambda: self._delta(c, mode))

    def _delta(self, c: Check, mode: str) -> DataFrame:
        edits = self.edits(mode)
        after = Check(self.library, stored(self.rewritten(edits)), strip=False)
        after.again = True
        after.digested, after.library_sentences, after.model = c.digested, c.library_sentences, c.model  # the library is the same
        changed = edits.groupBy("doc_id").agg(F.count("*").alias("changed"))
        rate = lambda c, n: c.rates.select("doc_id", F.col("total_rate").alias(n))
        machine = lambda c, n: c.machine_rates.select("doc_id", F.col("total_rate").alias(n))
        out = self.papers.select("doc_id", F.lit(mode).alias("mode")).join(changed, "doc_id", "left").na.fill(0, ["changed"])
        none = [F.lit(None).cast("double").alias(n) for n in ("dup_before", "dup_after", "machine_before", "machine_after")]
        for wanted, parts in ((mode != "humanize", (rate, "dup")), (mode != "dedup", (machine, "machine"))):
            measure, name = parts
            if wanted:
                out = out.join(measure(c, f"{name}_before"), "doc_id", "left").join(measure(after, f"{name}_after"), "doc_id", "left")
            else:
                out = out.select("*", *[x for x in none[:2]] if name == "dup" else none[2:])
        return out.select("doc_id", "mode", "changed", "dup_before", "dup_after", "machine_before", "machine_after")

    def web(self, pages: DataFrame) -> DataFrame:
        found = stored(web.web_candidates(self.results))
        self.release()
        matches = stored(web.best_pages(found, pages))
        return web.web_sources(found, matches, self.results)

    def full_report(self, mode: str = "full", pages: DataFrame | None = None) -> DataFrame:
        """(doc_id, report): one JSON document per paper.

        ``mode`` is full, plagiarism or aigc: a part that is not asked for is
        not computed and null. ``plagiarism`` has rates, fragments, sources,
        sentence results and, with ``pages``, the web part; ``aigc`` has every
        engine's outcome, features and paragraphs.
        """
        if mode not in ("full", "plagiarism", "aigc"):
            raise ValueError("mode must be full, plagiarism or aigc")
        # every part is stored, so that its shuffles are gone when the next one is made
        listed = lambda df, name, *cols: stored(df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)))
        out = stored(self.papers.select("doc_id", T.detect_language(F.col("text")).alias("language"), T.word_count(F.col("text")).alias("word_count")))
        plagiarism = aigc_part = F.lit(None).cast("string")
        if mode != "aigc":
            fragments = listed(self.fragments, "fragments", "start_pos", "end_pos", "text", "dup_units", "rate", "source_id", "sim")
            sources = listed(self.sources, "sources", (-F.col("dup_units")).alias("order"), "source_id", "dup_units", "hits", "rate")
            results = stored(report.listed_results(self.sentences, self.matches).select("doc_id", F.transform("sents", lambda x: x.dropFields("level")).alias("sent_results")))
            out = out.join(stored(self.rates), "doc_id", "left").join(fragments, "doc_id", "left").join(sources, "doc_id", "left").join(results, "doc_id", "left")
            if pages is not None:
                out = out.join(listed(self.web(pages), "web", (-F.col("units")).alias("order"), "page_id", "units", "hits", "rate"), "doc_id", "left")
            plagiarism = F.struct("total_rate", "quote_rate", "dup_units", "total_units", "sentence_count", "matched_sentences", "fragments", "sources", "sent_results", *(["web"] if pages is not None else []))
        if mode != "plagiarism":
            outcomes = listed(engines.outcomes(self.machine_rates), "engines", "place", "engine", "region", "status", "rate")
            features = listed(aigc.feature_rows(self.features), "features", "feature", "value")
            parts = listed(aigc.paragraphs(self.sentence_scores), "paragraphs", "paragraph", "start_pos", "end_pos", "rate", "high_count", "sentences")
            out = out.join(outcomes, "doc_id", "left").join(features, "doc_id", "left").join(parts, "doc_id", "left")
            aigc_part = F.struct("engines", "features", "paragraphs")
        options = F.struct(F.lit(mode).alias("mode"), F.lit(self.strip).alias("strip_references"), F.lit(pages is not None).alias("web_check"))
        return out.select("doc_id", F.to_json(F.struct("language", "word_count", plagiarism.alias("plagiarism"), aigc_part.alias("aigc"), options.alias("options"))).alias("report"))

    def html_report(self) -> DataFrame:
        """(doc_id, html): a page per paper, all text escaped.

        Rates with their bands, sources, fragments cut to 200 characters, engines, and the
        whole text with matched and machine-styled sentences marked.
        """
        cell = lambda c: F.concat(F.lit("<td>"), T.escape_html(c.cast("string")), F.lit("</td>"))
        line = lambda *cells: F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))

        def table(df: DataFrame, name: str, order: list, row: Column) -> DataFrame:
            # the rows of one paper, in order
            by = df.select("doc_id", F.struct(*order, row.alias("row")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
            # stored, so that its shuffles are gone when the next one is made
            return stored(by.select("doc_id", F.array_join(F.transform("r", lambda x: x["row"]), "").alias(name)))

        rate = F.format_string("%.1f", F.col("rate"))
        parts = [
            table(self.sources, "sources", [(-F.col("dup_units")).alias("a"), F.col("source_id").alias("b")], line(cell(F.col("source_id")), cell(F.col("hits")), cell(rate))),
            table(self.fragments, "fragments", [F.col("start_pos").alias("a"), F.col("fragment").alias("b")], line(cell(F.col("source_id")), cell(F.substring("text", 1, 200)))),
            table(engines.outcomes(self.machine_rates), "engines", [F.col("place").alias("a"), F.col("engine").alias("b")], line(cell(F.col("engine")), cell(F.col("status")), cell(F.coalesce(rate, F.lit("-"))))),
        ]

        def marked(x: Column) -> Column:
            mark = F.when(x["matched"], "dup").when(x["level"] == "high", "machine")
            return F.when(mark.isNull(), T.escape_html(x["text"])).otherwise(F.concat(F.lit("<mark class='"), mark, F.lit("'>"), T.escape_html(x["text"]), F.lit("</mark>")))

        sents = report.listed_results(self.sentences, self.matches, self.sentence_scores)
        parts.append(stored(sents.select("doc_id", F.array_join(F.transform("sents", marked), "").alias("body"))))
        out = stored(self.rates).join(stored(self.machine_rates.withColumnRenamed("total_rate", "machine_rate")), "doc_id", "left")
        for p in parts:
            out = out.join(p, "doc_id", "left")
        card = lambda name, c, band: F.concat(F.lit(f"<p class='{name} "), band, F.lit("'>"), F.format_string("%.1f", c), F.lit(" %</p>"))
        machine = F.coalesce("machine_rate", F.lit(0.0))
        out = out.withColumn("machine_rate", machine)
        whole = [F.concat(F.lit(f"<table class='{n}'>"), F.coalesce(n, F.lit("")), F.lit("</table>")) for n in ("sources", "fragments", "engines")]
        html = F.concat(
            F.lit("<html><body>"), card("dup", F.col("total_rate"), report.rate_band("total_rate")), card("machine", F.col("machine_rate"), report.machine_band("machine_rate")),
            *whole, F.lit("<pre>"), F.coalesce("body", F.lit("")), F.lit("</pre></body></html>"),
        )
        return out.select("doc_id", html.alias("html"))
