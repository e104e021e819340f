"""K: filing and headline text, always over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import annual, order, text_model
from tidemark.plans.registry import query
from tidemark.session import materialise

C = F.col

# words that occur in the driver's invented prose, standing in for topic words
TOPIC = ("license", "token", "that ", "les ", "und ")
# sentiment words; the invented texts hold only some of the bad ones, so the lists also have words of plain prose,
# without which nearly every label would be neutral: the query checks the counting
GOOD = ("good", "great", "gain", "growth", "profit", "thanks", "the", "and", "of", "to", "la", "der")
BAD = ("bad", "loss", "stupid", "worthless", "trash", "disgusting", "is", "on", "le", "die", "that", "for", "it")

LONG_LINES = "array_to_string(regexp_extract_all({c}, '[^\\n]{{20,}}'), chr(10))"


def _topic_sql(column: str) -> str:
    hit = " OR ".join(f"contains(s, '{w}')" for w in TOPIC)
    return f"len(list_filter(regexp_split_to_array(lower({column}), '[.!?]+'), lambda s: trim(s) <> '' AND ({hit})))"


@query(
    "k01_long_lines",
    "doc_id:i n:i digest:s",
    f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {LONG_LINES.format(c='text')} AS x FROM documents)",
)
def _(t):
    kept = t["documents"].select("doc_id", text.long_lines(C("text")).alias("x"))
    return kept.select("doc_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@query(
    "k02_first_characters",
    "doc_id:i kept:i whole:i digest:s",
    """SELECT doc_id, length(substr(text, 1, 7500)) AS kept, length(text) AS whole, md5(substr(text, 1, 7500)) AS digest
       FROM documents""",
)
def _(t):
    """The cut a length-limited scorer needs; every other text query reads the documents whole."""
    cut = t["documents"].select("doc_id", "text", text.first_characters(C("text"), 7500).alias("x"))
    return cut.select("doc_id", F.length("x").alias("kept"), F.length("text").alias("whole"), F.md5("x").alias("digest"))


@query(
    "k03_first_integer",
    "doc_id:i number:i",
    "SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT) AS number FROM documents",
)
def _(t):
    return t["documents"].select("doc_id", text.first_integer(C("text")).alias("number"))


@query("k04_topic_sentences", "doc_id:i n:i", f"SELECT doc_id, {_topic_sql('text')} AS n FROM documents")
def _(t):
    return t["documents"].select("doc_id", text.topic_sentences(C("text"), TOPIC).alias("n"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "k05_headline_sentiment",
    "conv_id:i turn:i label:s",
    f"""SELECT conv_id, turn, CASE WHEN g > b THEN 'positive' WHEN g < b THEN 'negative' ELSE 'neutral' END AS label FROM (
          SELECT conv_id, turn, len(list_intersect(list_distinct(w), {_list(GOOD)})) AS g,
                 len(list_intersect(list_distinct(w), {_list(BAD)})) AS b
          FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM conversations))""",
)
def _(t):
    return t["conversations"].select("conv_id", "turn", text.word_list_label(C("text"), GOOD, BAD).alias("label"))


@query(
    "k05_scorer_hook",
    "conv_id:i turn:i Sentiment:s",
    """SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN contains(text, '?') THEN 'negative'
              WHEN length(text) - length(replace(text, '.', '')) > 3 THEN 'positive' ELSE 'neutral' END AS Sentiment FROM conversations""",
)
def _(t):
    """A scorer of the user's own over whole texts: questions are negative, long answers positive."""

    def scorer(texts):
        label = texts.str.count(r"\.").gt(3).map({True: "positive", False: "neutral"})
        return label.mask(texts.str.contains("?", regex=False, na=False), "negative").mask(texts.isna(), None)

    return text.label_with(t["conversations"].select("conv_id", "turn", "text"), "text", scorer)


HELD_SQL = "CAST(('0x' || substr(md5('42|' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3"
#: The stand-in labels: toxic texts are negative, good ones positive, the others neutral.
OPINION_SQL = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END"


def _opinions(t):
    """Documents with a label, marked as teaching or judging, and the labels of a model that the teaching ones taught."""
    opinion = F.when(C("toxic") == 1, "negative").when(C("quality") == 1, "positive").otherwise("neutral")
    rows = t["labels"].select("doc_id", opinion.alias("label")).join(t["documents"].select("doc_id", "text"), "doc_id")
    rows = materialise(text_model.with_part(rows, ["doc_id"]))
    return rows, text_model.fit_text_model(rows.where("NOT is_held_out"), "text", "label")


@query("k05_text_model", "scorer:s n:i accuracy:f commonest:f")
def _(t):
    """How often the model, and the word lists beside it, name the label of documents that taught nothing."""
    rows, model = _opinions(t)
    held = rows.where("is_held_out")
    labels = {"model": text_model.label_texts(model, held), "word lists": held.withColumn("Sentiment", text.word_list_label(C("text"), GOOD, BAD))}
    tables = [text_model.agreement(df, "label", "Sentiment").withColumn("scorer", F.lit(name)) for name, df in labels.items()]
    return tables[0].unionByName(tables[1])


@query(
    "k05_text_model_beats_guessing",
    "n:i beats_commonest:b beats_word_lists:b",
    f"""SELECT count(*) AS n, 1 AS beats_commonest, 1 AS beats_word_lists
        FROM labels JOIN documents USING (doc_id) WHERE {HELD_SQL}""",
)
def _(t):
    rows, model = _opinions(t)
    both = text_model.label_texts(model, rows.where("is_held_out"), "learned").withColumn("listed", text.word_list_label(C("text"), GOOD, BAD))
    learned = text_model.agreement(both, "label", "learned").select("n", C("accuracy").alias("learned"), "commonest")
    listed = text_model.agreement(both, "label", "listed").select(C("accuracy").alias("listed"))
    return learned.withColumn("listed", listed.scalar()).select(
        "n", (C("learned") > C("commonest")).alias("beats_commonest"), (C("learned") > C("listed")).alias("beats_word_lists")
    )


@query("k05_headlines_by_model", "conv_id:i turn:i Sentiment:s")
def _(t):
    """The model's label of every headline."""
    return text_model.label_texts(_opinions(t)[1], t["conversations"].select("conv_id", "turn", "text"))


@query(
    "k06_last_line",
    "conv_id:i turn:i line:s",
    "SELECT conv_id, turn, string_split(text, chr(10))[-1] AS line FROM conversations",
)
def _(t):
    return t["conversations"].select("conv_id", "turn", text.last_line(C("text")).alias("line"))


COMPANY = r"https?://([^/]+)"


def filings(t):
    """Pages as filings: the host as company, newest page first."""
    return t["pages"].select("page_id", F.regexp_extract("url", COMPANY, 1).alias("ticker"), C("html").alias("text"))


YEARS_SQL = f"""SELECT page_id, ticker, text, 2012 + row_number() OVER (PARTITION BY ticker ORDER BY page_id DESC) AS year FROM (
    SELECT page_id, regexp_extract(url, '{COMPANY}', 1) AS ticker, html AS text FROM pages)"""


def with_year(df):
    """Number a company's documents backwards from its last one, starting in 2013."""
    numbered = order.row_index(df.select("page_id", "ticker"), ["page_id"], "_i", ["ticker"], ["page_id"])
    return numbered.select("page_id", "ticker", (C("_i") + 2013).cast("int").alias("year"))


@query("k07_year_by_position", "page_id:i ticker:s year:i", f"SELECT page_id, ticker, year FROM ({YEARS_SQL})")
def _(t):
    return with_year(filings(t))


@query(
    "k08_culture_counts",
    "ticker:s year:i culture_emphasis:f",
    f"""SELECT ticker, year, CASE WHEN n_name IS NOT NULL THEN n_nationkey ELSE c END AS culture_emphasis FROM (
          SELECT ticker, year, CAST({_topic_sql(LONG_LINES.format(c='text'))} AS DOUBLE) AS c FROM ({YEARS_SQL}) WHERE year <> 2013
          UNION ALL SELECT 'extra.example.org', 2023, 2.0)
        LEFT JOIN (SELECT n_name, n_nationkey, n_nationkey + 2014 AS y FROM nation) ON year = y AND ticker LIKE 'blog.%'""",
)
def _(t):
    """Topic sentences of every filing by company and year, cleaned and corrected."""
    pages = filings(t)
    counted = pages.select("page_id", text.topic_sentences(text.long_lines(C("text")), TOPIC).cast("double").alias("count"))
    reports = with_year(pages).join(counted, "page_id").select("ticker", "year", "count")
    blogs = reports.select("ticker").filter(C("ticker").startswith("blog.")).distinct()
    years = t["nation"].select((C("n_nationkey") + 2014).cast("int").alias("year"), C("n_nationkey").cast("double").alias("culture_emphasis"))
    corrections = reports.join(blogs, "ticker").select("ticker", "year").distinct().join(years, "year")
    missing = [{"ticker": "extra.example.org", "year": 2023, "culture_emphasis": 2.0}]
    return annual.culture_counts(reports, missing, corrections)
