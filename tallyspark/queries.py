"""The registered queries of the poll jobs; each runs over whole tables (see oracle.py for their SQL)."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import hashing, questions as q, rules, text as x
from .operators import builder, cluster, collections, headlines, pooling, polls as p, question_index as qi, reply_log, snapshots, terms
from .operators.keyed_store import merge_into_store, place_of, read_store, read_version
from .plans import views, workloads
from .shared import materialize, new_shared_path
from .sources import charts, outcomes, pages, sheets, toplines
from .streaming import ingest

TODAY = "2001-08-02"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def topic_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of polls that a topic rule matches; topics are matched once a wording."""
    return views.cells(spark, sf, pooling.with_topic(views.polls(spark, sf)).where("topic_id is not null"))


def pooled_topic_by_demographic(spark: SparkSession, sf: str) -> DataFrame:
    """Presidential approval by demographic, pooled over all polls."""
    return workloads.pooled_topic(topic_cells(spark, sf), "presidential-approval").withColumn("value", r6("value"))


def pooled_all_topics(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.pool(pooling.topic_answers(topic_cells(spark, sf))).withColumn("value", r6("value"))


def pooled_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = pooling.nest_pooled(pooling.pool(pooling.topic_answers(topic_cells(spark, sf))))
    return nested.select("topic_id", "demographic_id", F.size("answers").cast("long").alias("n_answers"), F.array_join(F.transform("answers", lambda a: a["id"]), "|").alias("ids"))


def answer_rollup(spark: SparkSession, sf: str) -> DataFrame:
    total = topic_cells(spark, sf).where("col_idx = 0")
    return pooling.roll_up(total, ["structure_idx", "topic_id"])


def demographic_mapping(spark: SparkSession, sf: str) -> DataFrame:
    named = pooling.with_demographic(views.cells(spark, sf))
    return named.groupBy("column_label", "demographic_id", "demographic_label", "group_id", "group_label").agg(F.count("*").alias("n_cells"))


def dedupe_demographics(spark: SparkSession, sf: str) -> DataFrame:
    answers = pooling.topic_answers(topic_cells(spark, sf))
    return answers.groupBy("structure_idx").agg(F.count_distinct("demographic_id").alias("n_demographics"), F.sum("value").alias("total"))


def structures_to_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Bars, pies and lines made of the answer rows, turned into cells again."""
    c = views.cells(spark, sf).where("col_idx = 0")
    rows = F.sort_array(F.collect_list(F.struct("row_idx", "row_label", "value")))
    made = c.groupBy("source_rank", "structure_idx").agg(rows.alias("r"))
    kind = F.element_at(F.array(F.lit("BarGraph"), F.lit("PieChart"), F.lit("LineGraph")), (F.pmod("structure_idx", F.lit(3)) + 1).cast("int"))
    structures = made.select(
        "source_rank", "structure_idx", kind.alias("type"), F.transform("r", lambda v: v["row_label"]).alias("x"), F.transform("r", lambda v: v["value"]).alias("y"),
        F.transform("r", lambda v: F.struct(v["row_label"].alias("label"), v["value"].alias("value"))).alias("slices"),
        F.transform("r", lambda v: F.struct(v["row_label"].alias("label"), F.array(v["value"], v["value"] + 1).alias("values"))).alias("series"),
    )
    return pooling.chart_cells(structures).select("structure_idx", F.col("row_idx").cast("int").alias("row_idx"), "row_label", "column_label", "value")


def collection_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of structures of all five kinds, with their topic or candidate and the sum of their answers."""
    seen = collections.map_collection(views.structures(spark, sf))
    demographics = F.size(F.array_distinct(F.transform("answers", lambda a: a["demographic_id"]))).cast("long")
    return seen.select("id", "topic_id", "compatibility", "source_collection", "poll_date", "question_title", "prompt", demographics.alias("n_demographics"), F.size("answers").cast("long").alias("n_answers"), r6(F.aggregate("answers", F.lit(0.0), lambda s, a: s + a["value"])).alias("total"))


def topic_matching(spark: SparkSession, sf: str) -> DataFrame:
    matched = pooling.with_topic(views.polls(spark, sf))
    labels = rules.catalog_table(spark).select("topic_id", "catalog_label")
    return matched.join(F.broadcast(labels), "topic_id", "left").groupBy("source_id", "title", "topic_id", "compatibility", "catalog_label").agg(F.count("*").alias("n"))


def latest_n_polls(spark: SparkSession, sf: str) -> DataFrame:
    return p.latest_entries(p.in_scope(views.polls(spark, sf), "months", 6, F.to_date(F.lit(TODAY))), 25).select("source_id", "poll_key", "published_on", F.col("place").cast("long").alias("place"))


def scope_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """How many polls each kind of scope holds, for the day of every poll's customer list."""
    frame = views.polls(spark, sf)
    day = F.col("published_on")
    return frame.groupBy("source_id").agg(*[F.min(x.cutoff_date(day, unit, 1)).alias(f"min_{unit}") for unit in ("days", "weeks", "months", "years")], *[F.max(x.cutoff_date(day, unit, 1)).alias(f"max_{unit}") for unit in ("months", "years")])


def dedupe_releases(spark: SparkSession, sf: str) -> DataFrame:
    return p.first_release(views.polls(spark, sf)).select("source_id", "article_url", "poll_key", "published_on", "copies")


def ingest_accounting(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.pmod("poll_key", F.lit(11)) == 0, "failed").when(F.pmod("poll_key", F.lit(7)) == 0, "skipped").otherwise("ok")
    frame = views.polls(spark, sf).select("source_id", F.col("poll_key").alias("ord"), status.alias("status"), "article_url")
    done = p.ingest_account(frame.withColumnRenamed("article_url", "detail"))
    return done.withColumn("failure_samples", F.array_join("failure_samples", "|"))


def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("prompt"))
    return p.retain_matches(docs, "The").select("doc_id")


def source_overview(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("BarGraph", "Crosstab", "Unstructured")
    structures = views.polls(spark, sf).where("source_id <> 'yougov'").select("source_id", views.pick(kinds, F.pmod("poll_key", F.lit(3))).alias("type"))
    sources = spark.createDataFrame([(s,) for s in views.SOURCES], "source_id string")
    return p.source_overview(sources, structures)


def collection_subtitles(spark: SparkSession, sf: str) -> DataFrame:
    return p.collection_subtitle(views.polls(spark, sf), "Latest")


def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(x.normalize_text(F.col("text"))).alias("normal_md5"), F.md5(x.search_text(F.col("text"))).alias("search_md5"), F.md5(x.slug(F.col("text"))).alias("slug_md5"))


def question_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    frame = views.questions(spark, sf)
    return frame.select("obs_id", q.clean_generic(F.concat_ws(": ", F.col("title"), F.col("prompt"))).alias("cleaned"), q.clean_for_source(F.col("source_id"), F.col("title")).alias("by_source"), q.question_key(F.col("title")).alias("question_key"), q.question_text(q.clean_generic(F.col("title")), q.clean_generic(F.col("prompt"))).alias("wording"))


def battery_items(spark: SparkSession, sf: str) -> DataFrame:
    frame = views.questions(spark, sf)
    return frame.select("obs_id", q.battery_item(F.concat_ws(" ", F.col("prompt"), F.col("p_name"))).alias("item")).where("item is not null")


def intent_detection(spark: SparkSession, sf: str) -> DataFrame:
    frame = views.questions(spark, sf)
    return frame.select("obs_id", rules.intent_of_label(F.concat_ws(" ", "title", "prompt")).alias("intent"))


def iso_dates_in_text(spark: SparkSession, sf: str) -> DataFrame:
    frame = views.polls(spark, sf)
    wrote = F.concat(F.lit("Poll "), F.when(F.pmod("poll_key", F.lit(5)) == 0, "1234567890 ").otherwise("no. 12-3 "), F.col("published_on").cast("string"), F.lit(": "), F.col("title"))
    return frame.select("poll_key", x.iso_date_text(wrote).alias("poll_date"))


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    frame = views.polls(spark, sf)
    long, short = F.date_format("published_on", "'Washington, DC, 'MMMM d, yyyy' - New polling'"), F.date_format("published_on", "dd'th 'MMM yyyy")
    return frame.select("poll_key", x.text_date(long).alias("long_date"), x.blog_date(short).alias("short_date"))


def number_parsing(spark: SparkSession, sf: str) -> DataFrame:
    line = views.table(spark, sf, "lineitem")
    cell = F.when(F.pmod("l_partkey", F.lit(5)) == 0, "n/a").when(F.pmod("l_partkey", F.lit(5)) == 1, "-").when(F.pmod("l_partkey", F.lit(5)) == 2, F.concat(F.lit("<"), F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).otherwise(F.format_string("1,%03d", F.col("l_quantity").cast("int")))
    row = F.concat(F.lit("Right direction "), F.col("l_linenumber").cast("string"), F.lit("% * "), F.col("l_quantity").cast("int").cast("string"))
    frame = line.select(x.chart_number(cell).alias("chart"), x.topline_number(cell).alias("topline"), x.percentage(F.concat(F.col("l_linenumber").cast("string"), F.lit("%"))).alias("percent"), x.scale_percent(F.col("l_quantity") / 10).alias("scaled"), x.row_label(row, 3).alias("label"), x.row_values(row, 3).alias("v"))
    return frame.groupBy("chart", "topline", "percent", "label").agg(F.count("*").alias("n"), r6(F.sum("scaled")).alias("scaled"), r6(F.sum(F.aggregate("v", F.lit(0.0), lambda a, b: a + b))).alias("row_sum"))


def term_extraction(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    found = terms.extract_terms(docs, "doc_id", "text")
    return found.select("doc_id", F.size("terms").alias("n_terms"), F.md5("signature").alias("signature_md5"), "intent")


def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    frame = views.questions(spark, sf)
    return frame.select("obs_id", hashing.hash16(F.concat_ws("|", "obs_id", "p_name")).alias("hash16"), hashing.hash8(F.col("p_name")).alias("hash8"))


def question_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return workloads.observations(spark, sf).select("obs_id", "question_fingerprint")


def apply_question_index(spark: SparkSession, sf: str) -> DataFrame:
    seen = workloads.observations(spark, sf)
    return qi.apply_index(seen, workloads.derived_index(seen)).select("obs_id", "topic_id", "topic_label", "compatibility", "applied")


def new_questions(spark: SparkSession, sf: str) -> DataFrame:
    seen = workloads.observations(spark, sf)
    return qi.new_questions(seen, workloads.derived_index(seen)).select("question_fingerprint", "obs_ord", "source_id", "title")


def classifier_output(spark: SparkSession, sf: str) -> DataFrame:
    labels = views.table(spark, sf, "labels")
    reply = F.concat(F.lit('<think>{"a": 1}</think> Here: ```{"canonical_topic_id": " '), F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("topic "), F.col("doc_id").cast("string"))), F.lit('", "canonical_label": "'), F.when(F.pmod("doc_id", F.lit(2)) == 0, "").otherwise("The Label"), F.lit('", "subject": ["Iran", "Military Action", "iran"], "confidence": '), F.when(F.col("quality") == 1, "84").otherwise("0.5"), F.when(F.col("toxic") == 1, ', "exclude_reason": " toxic "').otherwise(""), F.lit("}``` done"))
    raw = labels.select("doc_id", F.when(F.pmod("doc_id", F.lit(13)) == 0, "no json").otherwise(reply).alias("raw"))
    out = qi.parse_output(raw)
    return out.select("doc_id", "canonical_topic_id", "canonical_label", "confidence", F.array_join("subject", "|").alias("subjects"), "exclude_reason", "rejected", qi.review_status(F.col("exclude_reason"), F.col("confidence")).alias("review_status"))


def enrichment_batch(spark: SparkSession, sf: str) -> DataFrame:
    seen = workloads.observations(spark, sf)
    return workloads.enrichment_batch(seen, workloads.derived_index(seen)).select("question_fingerprint", "source_id", "canonical_topic_id", "model", "review_status")


def classifier_log(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names asked of a classifier that fails for some, of one that does not, and of one that always fails: records of the log and failures."""
    path = new_shared_path(spark, "replies")
    asked = views.questions(spark, sf).select(hashing.hash16(F.col("p_name")).alias("question_fingerprint"), F.lit("ipsos").alias("source_id"), F.col("p_name").alias("title"), F.lit("").alias("prompt"), F.array().cast("array<string>").alias("answer_labels")).distinct()

    def classifier(call: str, fails: str | None):
        def run(rows):
            if fails is not None and rows["title"].str.contains(fails, regex=False).any():
                raise TimeoutError(call)
            return ['{"canonical_topic_id": "%s", "canonical_label": "%s", "confidence": 0.9}' % (title, call) for title in rows["title"]]

        return run

    for call, fails in (("first", "ring"), ("second", None), ("third", "")):
        found = reply_log.classify_logged(asked, classifier(call, fails), "m", path)
    failed = reply_log.failures(reply_log.read_log(spark, path), "m").select("question_fingerprint", "failures", "reason")
    return found.join(failed, "question_fingerprint", "left").select("question_fingerprint", "canonical_topic_id", "canonical_label", "review_status", F.coalesce("failures", F.lit(0).cast("long")).alias("failures"), "reason")


def similar_question_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Scores between the wordings of headline candidates; moved a little, as the last digits of ties in rounding differ."""
    return cluster.similar_pairs(workloads.feature_nodes(spark, sf)).select("left", "right", F.round(F.col("precise") + 3e-7, 3).alias("score"))


def similar_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Scores between the word sets of parts, by the same filters; moved a little, as the last digits of ties in rounding differ."""
    return cluster.similar_pairs(workloads.part_nodes(spark, sf)).select("left", "right", F.round(F.col("precise") + 3e-7, 3).alias("score"))


def question_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return workloads.clustered(workloads.observations(spark, sf)).select("obs_ord", "cluster", "topic_id", "topic_label")


def headline_topics(spark: SparkSession, sf: str) -> DataFrame:
    seen = views.polls(spark, sf).withColumns({"topic_id": F.concat(F.lit("headline-"), x.slug(F.col("title"))), "topic_label": F.col("title"), "obs_ord": F.col("poll_key"), "source_collection": F.concat(F.lit("week "), F.weekofyear("published_on").cast("string")), "poll_date": F.when(F.pmod("poll_key", F.lit(3)) > 0, F.col("published_on").cast("string"))})
    matched = rules.topic_match(F.col("source_id"), rules.structure_text(F.col("title"), F.col("prompt")))
    own = seen.withColumn("topic_id", F.coalesce(matched["topic_id"], "topic_id"))
    return headlines.headline_summaries(own).orderBy(*headlines.headline_order())


def headline_workload(spark: SparkSession, sf: str) -> DataFrame:
    return workloads.headline_topics(workloads.observations(spark, sf)).drop("sample_questions")


def trend_series(spark: SparkSession, sf: str) -> DataFrame:
    return builder.trend_by_question(views.cells(spark, sf), "male").withColumn("place", F.col("place").cast("long"))


def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return builder.latest_bars(views.cells(spark, sf), "republican")


def wide_series(spark: SparkSession, sf: str) -> DataFrame:
    wide = builder.wide_rows(views.cells(spark, sf), ["Total", "Dem", "Republican", "Male"])
    return wide.select("structure_idx", "row_idx", "row_label", F.col("Total").alias("total"), F.col("Dem").alias("dem"), F.col("Republican").alias("republican"), F.col("Male").alias("male"))


def builder_options(spark: SparkSession, sf: str) -> DataFrame:
    return builder.options(views.cells(spark, sf))[1]


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    frame = views.table(spark, sf, "pages")
    url = F.col("url")
    return frame.select("page_id", pages.strip_slash(pages.clean_url(url)).alias("clean_url"), pages.url_host(url).alias("host"), pages.is_article_url(url, "example.com", "/en/", ("/en/1",)).alias("is_article"), pages.dataset_url(url).alias("dataset_url"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.elements(views.table(spark, sf, "pages"))
    return found.where("tag = 'a' and href is not null").select("page_id", "ordinal", pages.absolute_url(F.col("href"), "https://polls.example.com").alias("url"), "text")


def page_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Stubs and assets of articles written around each page's URL."""
    frame = views.table(spark, sf, "pages").select("page_id", F.concat(F.lit("<h2>Poll "), F.col("page_id").cast("string"), F.lit('</h2><a href="/poll/'), F.col("page_id").cast("string"), F.lit('">read</a><span>April 28, 2026</span><iframe data-src="https://datawrapper.dwcdn.net/'), F.col("page_id").cast("string"), F.lit('/"></iframe><a href="/a.pdf?x=1">pdf</a>'), "html").alias("html"))
    found = materialize(pages.elements(frame), "page-elements")  # two readers
    stubs = pages.release_stubs(found, "https://polls.example.com", "/poll/").select("page_id", F.lit("stub").alias("kind"), "title", F.col("article_url").alias("url"))
    assets = pages.page_assets(found, "https://polls.example.com").select("page_id", "kind", "title", "url")
    return stubs.unionByName(assets)


def chart_csv_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Line graphs and crosstab cells of CSV texts made of the lines of each order, counted by chart."""
    cells = materialize(charts.csv_cells(workloads.chart_texts(spark, sf)), "chart-cells")
    lines = charts.line_graphs(cells).select("chart_id", F.lit("line").alias("kind"), F.size("x").cast("long").alias("n_rows"), r6(F.aggregate(F.flatten(F.transform("series", lambda s: s["values"])), F.lit(0.0), lambda a, b: a + b)).alias("total"))
    tabs = charts.crosstab_cells(cells).groupBy("chart_id").agg(F.lit("crosstab").alias("kind"), F.count_distinct("row_idx").alias("n_rows"), r6(F.sum("value")).alias("total"))
    return lines.unionByName(tabs)


def source_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Charts as bytes, some of them undecodable, badly quoted, empty or missing: status, reason and number of rows of each."""
    raw = workloads.raw_charts(spark, sf)
    done = outcomes.parse_outcomes(raw, ["source_id", "chart_id"], "content", charts.parse_table_strictly, charts.TABLE)
    return done.select("source_id", "chart_id", "status", F.substring_index("failure", ":", 1).alias("reason"), F.coalesce(F.size(F.get("rows", F.lit(0))["body"]), F.lit(0)).cast("long").alias("n_rows"))


def source_account(spark: SparkSession, sf: str) -> DataFrame:
    """The account of the same charts by source, with the charts that failed first."""
    done = outcomes.parse_outcomes(workloads.raw_charts(spark, sf), ["source_id", "chart_id"], "content", charts.parse_table_strictly, charts.TABLE)
    detail = F.concat_ws(" ", F.col("chart_id").cast("string"), F.substring_index("failure", ":", 1))
    account = p.ingest_account(done.select("source_id", F.col("chart_id").alias("ord"), "status", detail.alias("detail")))
    return account.withColumn("failure_samples", F.array_join("failure_samples", "|"))


def sheet_topline(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.topline_bars(workloads.topline_sheets(spark, sf)).select("workbook", "question", "label", "value")


def sheet_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.crosstab_cells(workloads.crosstab_sheets(spark, sf)).select("workbook", "question", "answer", "group_title", "demographic", r6("value").alias("value"))


def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    lines = toplines.document_lines(views.table(spark, sf, "documents"))
    return lines.groupBy(toplines.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def topline_text_tables(spark: SparkSession, sf: str) -> DataFrame:
    return toplines.topline_cells(workloads.topline_texts(spark, sf)).select("doc_id", "question", "row_idx", "row_label", "col_idx", "column_label", "value")


def topline_panels(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of panels with fixed templates, summed up by answer and column."""
    cells = toplines.topline_cells(workloads.panel_texts(spark, sf), "templates")
    return cells.groupBy("question", "row_label", "col_idx", "column_label", "group_title").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


def topline_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Questions, prompts and panels of documents with page breaks, with the sum of each answer's cells."""
    rows = toplines.topline_rows(workloads.paged_panel_texts(spark, sf), "templates")
    n, total = F.size("values"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b)
    return rows.groupBy("doc_id", "question", "prompt", "panel", "row_idx", "row_label").agg(F.sum(n).alias("n"), F.min_by(F.element_at("group_titles", -1), F.struct((-n).alias("c"))).alias("last_group"), r6(F.sum(total)).alias("total"))


def topline_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a table, and those that stay as text, which no table was found in."""
    docs = materialize(workloads.panel_texts(spark, sf), "panel-texts")
    kept = toplines.with_fallback(docs, toplines.topline_cells(docs, "templates"))
    return kept.select("doc_id", "type", F.md5("data").alias("data_md5"))


def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """Polls of all sources by rank, and the source that can't be read as a warning."""
    every = views.polls(spark, sf)
    own = lambda name: lambda: every.where(F.col("source_id") == name).drop("source_rank")
    rows, warnings = p.load_sources(spark, {name: own(name) for name in views.SOURCES} | {"lost": lambda: spark.read.parquet(new_shared_path(spark, "lost"))})
    counted = rows.groupBy("source_id", "source_rank").agg(F.count("*").alias("n_polls"))
    return counted.withColumn("failed", F.lit(False)).unionByName(warnings.select("source_id", F.lit(None).cast("int").alias("source_rank"), F.lit(0).cast("long").alias("n_polls"), F.col("warning").startswith("lost unavailable: ").alias("failed")))


def topic_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the catalogue's topics, of topics of the polls, and of topics that nobody has asked about."""
    seen = views.polls(spark, sf).select(F.concat(F.lit("headline-"), F.col("question_no").cast("string")).alias("topic_id"), F.concat_ws(" ", "source_id", "title").alias("topic_label"), F.col("poll_key").alias("obs_ord"))
    sizes = views.table(spark, sf, "part").select(F.concat(F.lit("headline-"), F.col("p_size").cast("string")).alias("topic_id"))
    wanted = rules.catalog_table(spark).select("topic_id").unionByName(sizes.distinct())
    return headlines.lookup_topics(wanted, seen)


def question_index_store(spark: SparkSession, sf: str) -> DataFrame:
    """An index that is stored, read, updated for the larger parts and stored again."""
    path, schema = new_shared_path(spark, "index"), "question_fingerprint string, source_id string, confidence double, model string"
    asked = views.questions(spark, sf).withColumn("question_fingerprint", hashing.hash16(F.concat_ws("|", "obs_id", "p_name")))
    record = lambda df, confidence, model: df.select("question_fingerprint", "source_id", F.lit(confidence).alias("confidence"), F.lit(model).alias("model"))
    qi.write_index(record(asked, 0.5, "old"), path)
    qi.write_index(qi.upsert(qi.read_index(spark, path, schema), record(asked.where("p_size > 25"), 0.9, "new")), path)
    return qi.read_index(spark, path, schema)


def index_application(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an index over parts' names applied to the candidates among the observations."""
    return qi.apply_index(*workloads.named_parts(spark, sf)).select("obs_ord", "topic_id", "topic_label", "compatibility", "applied")


def index_new_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates without a record in that index, each fingerprint once."""
    return qi.new_questions(*workloads.named_parts(spark, sf)).select("question_fingerprint", "obs_ord", "title")


def document_headers(spark: SparkSession, sf: str) -> DataFrame:
    return toplines.document_titles(views.table(spark, sf, "documents"))


def latest_snapshot_state(spark: SparkSession, sf: str) -> DataFrame:
    events = views.table(spark, sf, "events")
    frame = events.select(F.col("event_id").alias("snapshot_id"), F.col("ts").cast("timestamp").alias("snapshot_ts"), views.pick(views.SOURCES, F.pmod("user_id", F.lit(4))).alias("source_id"), F.col("event_type").alias("scope"), (F.col("value") > 5).alias("readable"))
    out = p.latest_snapshots(frame, F.lit("2024-01-30 23:00:00").cast("timestamp"))
    return out.select("source_id", "scope", "snapshot_id", "readable_count", "fresh")


def snapshot_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Polls of each source served from snapshots on files: missing, fresh, future, unreadable, stale, stale with a failing source twice, and lost."""
    root, now = new_shared_path(spark, "source-snapshots"), datetime(2026, 5, 1, 12, tzinfo=UTC)
    every = materialize(views.polls(spark, sf).select("source_id", "poll_key", "published_on"), "polls")
    out = None
    for name in views.SOURCES:
        own, failing = every.where(F.col("source_id") == name), lambda: spark.read.parquet(f"{root}/nothing")
        first, whole = own.where("published_on < '1997-01-01'"), lambda own=own: own
        for scope, hours in (("fresh", 0.5), ("future", -3), ("unreadable", 0.2), ("stale", 2), ("failing", 2)):
            snapshots.write_snapshot(first, root, name, scope, now - timedelta(hours=hours))
        snapshots.write_snapshot(own, root, name, "unreadable", now)
        damaged = snapshots.newest_readable(spark, root, name, "unreadable", every.schema)
        files, at = place_of(spark, damaged.path)
        files.delete(at, True)
        for scope, call, load in (("missing", 1, whole), ("fresh", 1, failing), ("future", 1, failing), ("unreadable", 1, failing), ("stale", 1, whole), ("failing", 1, failing), ("failing", 2, failing), ("lost", 1, failing)):
            served = snapshots.serve(spark, root, name, scope, every.schema, load, now)
            rows = spark.createDataFrame([], every.schema) if served.rows is None else served.rows
            said = rows.agg(F.when(F.count("*") > 0, F.count("*")).alias("n"), F.sum("poll_key").alias("total")).select(F.lit(scope).alias("scope"), F.lit(name).alias("source_id"), F.lit(call).alias("call"), F.lit(served.state).alias("state"), F.lit(served.warning is not None).alias("warning"), "n", "total")
            out = said if out is None else out.unionByName(said)
    return out


def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a file stream of releases; the appended releases, merged with none before."""
    schema = views.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/event[s].parquet")
    releases = stream.select(views.pick(views.SOURCES, F.pmod("user_id", F.lit(4))).alias("source_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("article_url"), F.col("ts").cast("timestamp").alias("seen_at"), "event_id")
    path = new_shared_path(spark, "ingest")
    ingest.start_ingest(releases, f"{path}/data", f"{path}/state", "60 days").awaitTermination()
    return spark.read.parquet(f"{path}/data").groupBy("source_id").agg(F.count("*").alias("n_releases"), F.count_distinct("article_url").alias("n_urls"))


def snapshot_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as releases that come in four batches, late and again; the newest row of each source and URL."""
    path = new_shared_path(spark, "snapshots")
    events = views.table(spark, sf, "events").select(views.pick(views.SOURCES, F.pmod("user_id", F.lit(4))).alias("source_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("article_url"), F.col("ts").cast("timestamp").alias("seen_at"), "event_id")
    for k in (2, 0, 3, 1):
        again = F.pmod("event_id", F.lit(4)) == k
        events.where(again | (F.pmod("event_id", F.lit(40)) == 0)).write.parquet(f"{path}/in/part={k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in/part=*")
        ingest.start_snapshots(stream, f"{path}/store", f"{path}/state", 16).awaitTermination()
    return read_store(spark, f"{path}/store", events.schema).select("source_id", "article_url", "event_id")


def pooled_incrementally(spark: SparkSession, sf: str) -> DataFrame:
    """All topics pooled from a stored state, into which the polls come in three parts."""
    answers = pooling.topic_answers(topic_cells(spark, sf))
    path, keys = new_shared_path(spark, "pooled"), ["topic_id", "demographic_id", "answer_id"]
    answers = materialize(answers.withColumn("part", F.pmod("structure_idx", F.lit(3))), "answers")
    for k in (1, 0, 2):
        state = pooling.pool_state(answers.where(F.col("part") == k))
        merge_into_store(path, state, keys, pooling.merge_pool_states, 16)
    return pooling.pooled_of_state(read_store(spark, path, state.schema)).withColumn("value", r6("value"))


def question_index_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all parts' names in a keyed store, with later records of single names put in."""
    path = new_shared_path(spark, "keyed-index")
    asked = views.questions(spark, sf).withColumn("question_fingerprint", hashing.hash16(F.col("p_name")))
    record = lambda df, model: df.groupBy("question_fingerprint").agg(F.min("p_name").alias("title"), F.lit(model).alias("model"))
    qi.upsert_stored(path, record(asked, "first"))
    for word in ("small", "ring"):
        last = qi.upsert_stored(path, record(asked.where(F.col("p_name").contains(word)), word))
    return read_version(spark, path, record(asked, "").schema, last)


QUERIES = {f.__name__: f for f in (
    pooled_topic_by_demographic, pooled_all_topics, pooled_nested, answer_rollup, demographic_mapping, dedupe_demographics, structures_to_answers, collection_observations, topic_matching, latest_n_polls, scope_cutoffs, dedupe_releases,
    ingest_accounting, keyword_filter, source_overview, collection_subtitles, text_normalise, question_cleaning, battery_items, intent_detection, iso_dates_in_text, text_dates, number_parsing, term_extraction, text_hashes,
    question_fingerprint, apply_question_index, new_questions, classifier_output, classifier_log, enrichment_batch, similar_question_pairs, similar_parts, question_clusters, headline_topics, headline_workload, trend_series, latest_snapshot, wide_series,
    builder_options, page_urls, page_links, page_assets, chart_csv_tables, source_failures, source_account, sheet_topline, sheet_crosstab, line_kinds, topline_text_tables, topline_panels, topline_pages, topline_fallback, document_headers, source_union, topic_lookup, question_index_store, index_application, index_new_questions, latest_snapshot_state, snapshot_refresh, incremental_ingest, snapshot_ingest, pooled_incrementally, question_index_upserts,
)}
