"""Readers of landed provider payloads: explicit schemas, bad lines kept as gaps, one row per observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES_SCHEMA = (
    "series struct<id:string,title:string,units:string,frequency:string>, observations array<struct<date:string,value:string>>, "
    "retrieved_at string, _corrupt_record string"
)
FACTS_SCHEMA = (
    "cik bigint, entityName string, facts map<string,map<string,struct<units:map<string,array<struct<val:double,start:string,`end`:string,"
    "filed:string,form:string,accn:string,frame:string>>>>>>, _corrupt_record string"
)
FILINGS_SCHEMA = (
    "cik string, name string, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,"
    "primaryDocument:array<string>>>, _corrupt_record string"
)
KLINE_SCHEMA = (
    "symbol string, data struct<kline_list:array<struct<timestamp:string,open_price:string,high_price:string,low_price:string,"
    "close_price:string,volume:string>>>, _corrupt_record string"
)
#: Forms whose facts count.
FACT_FORMS = ("10-K", "10-Q", "20-F", "40-F")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; unreadable lines keep their text in _corrupt_record."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def gaps(rows: DataFrame) -> DataFrame:
    """One gap per unreadable line."""
    return rows.where(F.col("_corrupt_record").isNotNull()).select(F.lit("payload_unreadable").alias("code"), F.col("_corrupt_record").alias("detail"))


def _number(text: Column) -> Column:
    value = F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("None")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def macro_observations(rows: DataFrame) -> DataFrame:
    """series_id, date, value; '.' and other text that is no number is skipped, the last of a date wins."""
    return (
        rows.select("series.id", F.posexplode("observations").alias("pos", "o"))
        .select(F.upper(F.trim("id")).alias("series_id"), F.col("o.date").try_cast("date").alias("date"), _number(F.col("o.value")).alias("value"), "pos")
        .where("date is not null and value is not null")
        .groupBy("series_id", "date")
        .agg(F.max_by("value", "pos").alias("value"))
    )


def latest_facts(rows: DataFrame) -> DataFrame:
    """cik, concept, unit and the newest value among annual and quarterly forms, with its period."""
    concepts = rows.select("cik", F.explode("facts").alias("taxonomy", "concepts")).select("cik", F.explode("concepts").alias("concept", "c"))
    entries = concepts.select("cik", "concept", F.explode("c.units").alias("unit", "list")).select("cik", "concept", "unit", F.explode("list").alias("e"))
    return (
        entries.where(F.col("e.form").isin(*FACT_FORMS) & F.col("e.val").isNotNull())
        .groupBy("cik", "concept", "unit")
        .agg(F.max_by("e", F.struct("e.end", "e.filed", F.col("e.frame").isNotNull(), F.coalesce("e.start", F.lit("")))).alias("e"))
        .select("cik", "concept", "unit", F.col("e.val").alias("value"), F.concat_ws("/", "e.start", "e.end").alias("period"))
    )


def filings(rows: DataFrame, forms: list[str], limit: int) -> DataFrame:
    """The first filings of the forms asked for, in the provider's order; parallel arrays may differ in length."""
    recent = F.arrays_zip("filings.recent.form", "filings.recent.accessionNumber", "filings.recent.filingDate")
    listed = rows.select("cik", F.posexplode(recent).alias("pos", "f")).select(
        "cik", "pos", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession"), F.col("f.filingDate").alias("filed")
    )
    wanted = listed.where(F.col("form").isin([f.upper() for f in forms]))
    return wanted.withColumn("place", F.row_number().over(W.partitionBy("cik").orderBy("pos"))).where(F.col("place") <= limit)


def klines(rows: DataFrame) -> DataFrame:
    """symbol, date and prices; a missing or zero open, high or low is the close, a missing volume 0."""
    b = rows.select("symbol", F.explode("data.kline_list").alias("k"))
    stamp = F.col("k.timestamp").try_cast("bigint")
    close = _number(F.col("k.close_price"))
    other = lambda name: F.coalesce(F.nullif(_number(F.col(f"k.{name}")), F.lit(0.0)), close)
    return b.select(
        "symbol",
        F.to_date(F.timestamp_seconds(F.when(stamp > 10_000_000_000, (stamp / 1000).cast("bigint")).otherwise(stamp))).alias("date"),
        other("open_price").alias("open"),
        other("high_price").alias("high"),
        other("low_price").alias("low"),
        close.alias("close"),
        F.coalesce(_number(F.col("k.volume")), F.lit(0.0)).alias("volume"),
    ).where("date is not null and close is not null")


SCHEMAS: dict[str, T.StructType | str] = {"macro": SERIES_SCHEMA, "facts": FACTS_SCHEMA, "filings": FILINGS_SCHEMA, "klines": KLINE_SCHEMA}

HISTORY_SCHEMA = (
    "symbol string, chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>>>>"
)
DAILY_SCHEMA = "symbol string, daily map<string,struct<close:string,volume:string>>"
QUOTE_SCHEMA = (
    "symbol string, company string, currency string, as_of string, current_price string, monthly_return string, market_cap string, trailing_pe string, "
    "price_to_book string, price_to_sales string, enterprise_to_ebitda string, fifty_two_week_high string, fifty_two_week_low string"
)
TICK_SCHEMA = "data struct<tick_list:array<struct<code:string,tick_time:string,price:string,last_price:string,px:string>>>"
BARS_SCHEMA = "symbol string, bars array<map<string,string>>"
OCR_SCHEMA = "page int, blocks array<struct<block_label:string,block_content:string,block_order:int,block_id:int>>"
SEARCH_SCHEMA = "web struct<results:array<struct<title:string,url:string,description:string,extra_snippets:array<string>,page_age:string>>>"
PAGES_SCHEMA = "data struct<webPages:struct<value:array<struct<name:string,url:string,snippet:string,summary:string,datePublished:string>>>>"
SCHEMAS |= {"history": HISTORY_SCHEMA, "daily": DAILY_SCHEMA, "quote": QUOTE_SCHEMA, "tick": TICK_SCHEMA, "bars": BARS_SCHEMA, "ocr": OCR_SCHEMA, "search": SEARCH_SCHEMA, "pages": PAGES_SCHEMA}
# Bars that a range keeps, for daily maps and for other histories.
DAILY_TAILS = {"1mo": 23, "3mo": 66, "6mo": 132, "1y": 264, "2y": 528, "5y": 1320, "10y": 2640}
BAR_TAILS = {"1mo": 22, "3mo": 66, "6mo": 132, "1y": 252, "2y": 500, "5y": 500, "10y": 500}
# The fields of a quote that become facts, with their unit ('' for the quote's currency).
QUOTE_FIELDS = {
    "current_price": "", "market_cap": "", "fifty_two_week_high": "", "fifty_two_week_low": "", "monthly_return": "ratio", "trailing_pe": "ratio",
    "price_to_book": "ratio", "price_to_sales": "ratio", "enterprise_to_ebitda": "ratio",
}
# Concepts and the label they report, the more particular concept of a label first.
LABELS = [
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenue"), ("Revenues", "Revenue"), ("GrossProfit", "Gross profit"),
    ("OperatingIncomeLoss", "Operating income"), ("NetIncomeLoss", "Net income"), ("Assets", "Total assets"), ("AssetsCurrent", "Current assets"),
    ("Liabilities", "Total liabilities"), ("LiabilitiesCurrent", "Current liabilities"), ("StockholdersEquity", "Stockholders' equity"),
    ("CashAndCashEquivalentsAtCarryingValue", "Cash and cash equivalents"), ("NetCashProvidedByUsedInOperatingActivities", "Operating cash flow"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "Capital expenditure"), ("EarningsPerShareDiluted", "Diluted earnings per share"),
]


def parsed(rows: DataFrame, payload: str, kind: str) -> DataFrame:
    """Landed JSON texts in a column, read by the schema of their kind; unreadable ones give nulls."""
    return rows.select(F.from_json(payload, SCHEMAS[kind]).alias("p")).select("p.*")


def _day(text: Column) -> Column:
    """A date from epoch seconds or milliseconds, or from the first ten characters of a text."""
    stamp = text.try_cast("bigint")
    return F.when(stamp.isNotNull(), F.to_date(F.timestamp_seconds(F.when(stamp > 10_000_000_000, (stamp / 1000).cast("bigint")).otherwise(stamp)))).otherwise(
        F.substring(text, 1, 10).try_cast("date")
    )


def chart_history(rows: DataFrame) -> DataFrame:
    """symbol, date, close and price_basis of chart payloads: adjusted closes where there are any, else closes; null and
    non-positive ones drop out, the last of a date wins."""
    first = F.get("chart.result", F.lit(0))
    adjusted, plain = F.get(first["indicators"]["adjclose"], F.lit(0))["adjclose"], F.get(first["indicators"]["quote"], F.lit(0))["close"]
    basis = F.when(adjusted.isNotNull(), "adjusted_close").otherwise("close")
    points = rows.select("symbol", basis.alias("price_basis"), F.posexplode(F.arrays_zip(first["timestamp"].alias("at"), F.coalesce(adjusted, plain).alias("close"))).alias("pos", "x"))
    held = points.select("symbol", "price_basis", "pos", F.to_date(F.timestamp_seconds("x.at")).alias("date"), F.col("x.close").alias("close"))
    return held.where("close > 0 AND date IS NOT NULL").groupBy("symbol", "date").agg(F.max_by("close", "pos").alias("close"), F.max_by("price_basis", "pos").alias("price_basis"))


def daily_history(rows: DataFrame) -> DataFrame:
    """symbol, date and close of payloads that map dates to texts of numbers."""
    points = rows.select("symbol", F.explode("daily").alias("date", "v"))
    return points.select("symbol", F.col("date").try_cast("date").alias("date"), _number(F.col("v.close")).alias("close")).where("date is not null and close > 0")


def bar_history(rows: DataFrame) -> DataFrame:
    """symbol, date, open, high, low, close and volume of bars with provider-specific keys; open, high and low default to the
    close, volume to 0."""
    bars = rows.select("symbol", F.explode("bars").alias("b"))
    key = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("b", F.lit(n))), F.lit("")) for n in names])
    close = _number(key("c", "close", "spj"))
    other = lambda *names: F.coalesce(F.nullif(_number(key(*names)), F.lit(0.0)), close)
    return bars.select(
        "symbol",
        _day(key("t", "time", "date", "d")).alias("date"),
        other("o", "open", "kpj").alias("open"),
        other("h", "high", "zgj").alias("high"),
        other("l", "low", "zdj").alias("low"),
        close.alias("close"),
        F.coalesce(_number(key("v", "volume", "cjl")), F.lit(0.0)).alias("volume"),
    ).where("date is not null and close is not null")


def tail(points: DataFrame, series: str, at: str, most: int) -> DataFrame:
    """The last points of every series; each is cut to them inside tasks before the shuffle."""
    return points.withColumn("__n", F.row_number().over(W.partitionBy(series).orderBy(F.desc(at)))).where(F.col("__n") <= most).drop("__n")


def first_ticks(rows: DataFrame) -> DataFrame:
    """symbol, as_of and current_price of tick payloads: the first tick, its price under any of its names."""
    tick = F.get("data.tick_list", F.lit(0))
    return rows.select(
        F.upper(tick["code"]).alias("symbol"), _day(tick["tick_time"]).alias("as_of"), F.coalesce(*[_number(tick[n]) for n in ("price", "last_price", "px")]).alias("current_price")
    ).where("symbol is not null")


def quote_facts(rows: DataFrame) -> DataFrame:
    """symbol, entity, field_name, value, unit and as_of of the numbers of quotes."""
    made = F.array(*[F.struct(F.lit(f).alias("field_name"), _number(F.col(f)).alias("value"), F.coalesce(F.nullif(F.lit(u), F.lit("")), F.col("currency")).alias("unit")) for f, u in QUOTE_FIELDS.items()])
    return rows.select("symbol", F.col("company").alias("entity"), "as_of", F.explode(made).alias("x")).select("symbol", "entity", "x.field_name", "x.value", "x.unit", "as_of").where("value is not null")


def quote_gaps(rows: DataFrame, required: list[str] | None = None) -> DataFrame:
    """symbol, code and missing fields: no required field there, some missing, or no date."""
    names = required or list(QUOTE_FIELDS)
    have = F.filter(F.array(*[F.when(_number(F.col(f)).isNotNull(), f) for f in names]), lambda x: x.isNotNull())
    missing = F.array_except(F.array(*[F.lit(f) for f in names]), have)
    code = F.when(F.size(missing) == len(names), "market_provider_unavailable").when(F.size(missing) > 0, "market_fields_missing")
    held = rows.select("symbol", code.alias("code"), missing.alias("missing"), F.coalesce(F.trim("as_of"), F.lit("")).alias("as_of"))
    undated = held.where("as_of = ''").select("symbol", F.lit("market_as_of_missing").alias("code"), F.array().cast("array<string>").alias("missing"))
    return held.where("code is not null").select("symbol", "code", "missing").unionByName(undated)


def labelled_facts(facts: DataFrame) -> DataFrame:
    """Facts (cik, concept, unit, value, period) under their labels: of several concepts of a label the first listed wins."""
    names = facts.sparkSession.createDataFrame([(c, label, i) for i, (c, label) in enumerate(LABELS)], "concept string, label string, place int")  # the fixed list
    row = F.struct("value", "period", "concept")
    return facts.join(names, "concept").groupBy("cik", "unit", "label").agg(F.min_by(row, "place").alias("x")).select("cik", "label", "unit", "x.value", "x.period", "x.concept")


def ocr_blocks(rows: DataFrame, document: str) -> DataFrame:
    """document, page, number, label, content and title of landed pages of recognised blocks in their order; headers, footers
    and numbers drop out, titles run forward inside a page."""
    b = rows.select(document, "page", F.posexplode("blocks").alias("pos", "b")).select(
        document, "page", "pos", F.lower(F.coalesce("b.block_label", F.lit("text"))).alias("raw"), F.trim(F.coalesce("b.block_content", F.lit(""))).alias("content"), F.coalesce("b.block_order", F.lit(1 << 30)).alias("o"), F.coalesce("b.block_id", F.lit(1 << 30)).alias("i")
    )
    order = W.partitionBy(document, "page").orderBy("o", "i", "pos")  # the blocks of a page
    label = F.when(F.col("raw").isin("doc_title", "paragraph_title", "figure_title"), "heading").when(F.col("raw").isin("table", "chart"), F.col("raw")).otherwise("text")
    held = b.where((F.col("content") != "") & ~F.col("raw").isin("header", "header_image", "footer", "footer_image", "number"))
    title = F.last(F.when(label == "heading", F.col("content")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return held.select(document, "page", (F.row_number().over(order) - 1).alias("number"), label.alias("label"), "content", title.alias("title"))


def search_results(rows: DataFrame, search: str, most: int) -> DataFrame:
    """search, rank, title, url, description, extra_snippets and published_at of landed web searches (``web``)."""
    held = rows.select(search, F.posexplode("web.results").alias("pos", "r")).where(F.col("pos") < most)
    return held.select(search, (F.col("pos") + 1).alias("rank"), "r.title", "r.url", "r.description", "r.extra_snippets", F.col("r.page_age").alias("published_at"))


def page_results(rows: DataFrame, search: str, most: int) -> DataFrame:
    """As ``search_results``, of searches that land as webPages; the summary is the one extra snippet."""
    held = rows.select(search, F.posexplode("data.webPages.value").alias("pos", "r")).where(F.col("pos") < most)
    extra = F.filter(F.array("r.summary"), lambda x: x.isNotNull())
    return held.select(search, (F.col("pos") + 1).alias("rank"), F.col("r.name").alias("title"), "r.url", F.col("r.snippet").alias("description"), extra.alias("extra_snippets"), F.col("r.datePublished").alias("published_at"))
