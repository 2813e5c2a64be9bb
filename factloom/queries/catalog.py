"""Queries over catalog pages made of parts: five layouts, some pages in two of them, with noise around the items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.operators.extract import long_fields
from factloom.operators.fields import field_coverage
from factloom.operators.stats import listing_statistics
from factloom.plans.page_flow import PageFlow
from factloom.queries.registry import query, table
from factloom.sources.pages import from_table

CATALOG_FLOW = PageFlow(EngineConfig(min_file_bytes=100))
PER_PAGE = 8
LAYOUTS = ("list", "cards", "rows", "terms", "boxes")
_NOISE = '<svg><svg><path d="M1"/></svg><text>$1</text></svg><!-- <li><a href="/no">no</a> $1</li> -->'
_HEAD = (
    "<!DOCTYPE html><html><head><meta charset=utf-8><script>var a=\"<li><a href='/no'>no</a> $1</li>\";</script><title>"
)
_MENU = (
    '<nav><ul><li><a href="/m1">Home</a></li><li><a href="/m2">Deals</a></li><li><a href="/m3">About us</a></li></ul></nav>'
)
_HEADER = "<tr><th>Product</th><th>Price</th><th>Condition</th><th>Location</th><th>Warehouse</th></tr>"


def _facts() -> dict[str, Column]:
    """What a page says about a part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    return {
        "title": F.col("p_name"),
        "link": F.concat(F.lit("/p/"), text(key)),
        "price": F.concat(F.lit("$"), text(F.col("p_retailprice"))),
        "image": F.concat(F.lit("/i/"), text(key), F.lit(".png")),
        "condition": pick(size, "New", "Used", "Refurbished", "Open box"),
        "rating": F.concat(text(1 + size % 5), F.lit(".5 out of 5 stars")),
        "reviews": F.concat(F.lit("("), text(size * 11), F.lit(")")),
        "seller": F.col("p_brand"),
        "place": pick(key, "Austin, TX", "Boise, ID", "Salem, OR"),
        "date": F.concat(F.lit("Dec-"), F.lpad(text(1 + key % 28), 2, "0"), F.lit(" 10:00")),
        "shipping": pick(size, "Free shipping", "$4 shipping"),
        "warehouse": F.concat(F.lit("W"), text(size % 7)),
    }


def _blocks() -> dict[str, Column]:
    """A part's block in each layout."""
    facts = _facts()

    def filled(template: str) -> Column:
        parts = []
        for at, part in enumerate(template.split("|")):
            parts.append(facts[part] if at % 2 else F.lit(part))
        return F.concat(*parts)

    return {
        "list": filled(
            '<li class="hit"><img alt="1 > 0" src="|image|"><a title="a > b" href="|link|">|title|</a> <span class="price">|price|'
            "</span> <i>|condition|</i><span>|rating|</span><span>|reviews|</span>"
        ),
        "cards": filled(
            '<h3><a href="|link|">|title|</a></h3><p class="price">|price|<p>Condition: |condition|<p>Seller: |seller|</p>'
            "<p>Located in |place|</p>"
        ),
        "rows": filled(
            '<tr><td><a href="|link|">|title|</a><td>|price|</td><td>|condition|</td><td>|place|</td><td>|warehouse|</td></tr>'
        ),
        "terms": filled('<dt><a href="|link|">|title|</a></dt><dd>|price|</dd><dd class="date">|date|</dd><dd>Seller: |seller|'),
        "boxes": filled(
            '<div class="item"><div class="pic"><img src="|image|"></div><div class="body"><a href="|link|">|title|</a><b>|price|</b>'
            '<span class="brand-name">|seller|</span><span>|shipping|</span><a href="/cart">Add to cart</a></div></div>'
        ),
    }


#: Fields of each layout, in the order in which the engine gives them.
FIELDS = {
    "list": ("title", "link", "price", "image", "condition", "rating", "reviews"),
    "cards": ("title", "link", "price", "condition", "seller", "place"),
    "rows": ("title", "link", "price", "condition", "place", "warehouse"),
    "terms": ("title", "link", "price", "date", "seller"),
    "boxes": ("title", "link", "price", "image", "brand_name", "shipping"),
}
_AROUND = {
    "list": ("<ul>", "</ul>"),
    "cards": ("<section>", "</section>"),
    "rows": (f"<table>{_HEADER}", "</table>"),
    "terms": ("<dl>", "</dl>"),
    "boxes": ("<div>", "</div>"),
}


def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts a page; on every seventh page the first two are a list of their own."""
    blocks = _blocks()
    page = F.floor(F.col("p_partkey") / PER_PAGE)
    layout = page % len(LAYOUTS)
    apart = (page % 7 == 3) & (F.col("p_partkey") % PER_PAGE < 2)
    own = F.when(apart, blocks["list"])
    for i, name in enumerate(LAYOUTS):
        own = own.when(layout == i, blocks[name])
    placed = F.struct("p_partkey", own.otherwise("").alias("block"), apart.alias("apart"))
    pages = table(spark, sf_dir, "part").groupBy(page.alias("page_id")).agg(F.sort_array(F.collect_list(placed)).alias("parts"))
    joined = lambda first: F.array_join(
        F.transform(F.filter("parts", lambda p: p["apart"] if first else ~p["apart"]), lambda p: p["block"]), ""
    )
    opened, closed = F.lit(""), F.lit("")
    for i, name in enumerate(LAYOUTS):
        here = F.col("page_id") % len(LAYOUTS) == i
        opened = F.when(here, F.lit(_AROUND[name][0])).otherwise(opened)
        closed = F.when(here, F.lit(_AROUND[name][1])).otherwise(closed)
    title = F.concat(F.lit("Catalog "), F.col("page_id").cast("string"))
    html = F.concat(
        F.lit(_HEAD), title, F.lit(f"</title></head><body>{_MENU}{_NOISE}<h1>"), title, F.lit("</h1><ul>"), joined(True),
        F.lit("</ul>"), opened, joined(False), closed, F.lit("<p>&copy; shop</p></body></html>"),
    )
    url = F.concat(F.lit("https://www.shop.example.com/catalog/"), F.col("page_id").cast("string"))
    return pages.select("page_id", url.alias("url"), html.alias("html"))


def _layout(page_id: str = "page_id") -> str:
    return f"['{"', '".join(LAYOUTS)}'][({page_id} % {len(LAYOUTS)})::INT + 1]"


# The items as the pages were made from them.
CATALOG = f"""
facts AS (
  SELECT p_partkey // {PER_PAGE} AS page_id, (p_partkey % {PER_PAGE})::INT AS pos, p_name AS title, '/p/' || p_partkey AS link,
    '$' || p_retailprice AS price, p_retailprice AS amount, '/i/' || p_partkey || '.png' AS image,
    ['New', 'Used', 'Refurbished', 'Open box'][p_size % 4 + 1] AS condition,
    (1 + p_size % 5) || '.5 out of 5 stars' AS rating, '(' || (p_size * 11) || ')' AS reviews, p_brand AS seller,
    p_brand AS brand_name, ['Austin, TX', 'Boise, ID', 'Salem, OR'][(p_partkey % 3)::INT + 1] AS place,
    'Dec-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') || ' 10:00' AS date,
    ['Free shipping', '$4 shipping'][p_size % 2 + 1] AS shipping, 'W' || (p_size % 7) AS warehouse
  FROM part),
items AS (
  SELECT *, CASE WHEN page_id % 7 = 3 AND pos < 2 THEN 'list' ELSE {_layout()} END AS layout FROM facts),
fields AS (
  {" UNION ALL ".join(
    f"SELECT page_id, layout, pos, {at} AS field_pos, '{name}' AS field, {name} AS value, 'string' AS value_type "
    f"FROM items WHERE layout = '{layout}'" for layout, names in FIELDS.items() for at, name in enumerate(names))})"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG_FLOW.extracted(from_table(catalog_pages(spark, sf_dir)))


@query(
    "catalog_items",
    f"WITH {CATALOG} SELECT page_id, pos, field_pos, field, value, value_type FROM fields",
)
def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of every layout, with the fields of its parts."""
    return long_fields(extracted(spark, sf_dir), "page_id")


@query(
    "catalog_profile",
    f"""WITH {CATALOG},
    pages AS (
      SELECT page_id, count(*) AS n, count(*) FILTER (layout = 'list') AS listed FROM items GROUP BY page_id),
    names AS (
      SELECT page_id, string_agg(field, ',' ORDER BY first) AS expected_fields FROM (
        SELECT page_id, field, min(CASE field WHEN 'title' THEN -3 WHEN 'link' THEN -2 WHEN 'price' THEN -1
          ELSE pos * 100 + field_pos END) AS first FROM fields GROUP BY page_id, field) GROUP BY page_id)
    SELECT page_id, 'category listing' AS page_type, 'shop.example.com' AS source, 'catalog' AS category,
      'multiple (estimate ' || n || ')' AS item_count, expected_fields, 'high' AS confidence,
      (3 + listed) || ' list entries, 1 main headings, 0 structured items' AS notes
    FROM pages JOIN names USING (page_id)""",
)
def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = CATALOG_FLOW.profiled(from_table(catalog_pages(spark, sf_dir)))
    return profiled.select(
        "page_id", "hypothesis.page_type", "hypothesis.source", "hypothesis.category", "hypothesis.item_count",
        F.array_join("hypothesis.expected_fields", ",").alias("expected_fields"), "hypothesis.confidence", "hypothesis.notes",
    )


@query(
    "catalog_validation",
    f"""WITH {CATALOG},
    counted AS (
      SELECT page_id, count(*) AS n, count(*) FILTER (layout NOT IN ('list', 'cards', 'rows')) AS no_condition,
        count(*) FILTER (layout <> 'boxes') AS no_shipping FROM items GROUP BY page_id)
    SELECT page_id, 'success' AS status, 'excellent' AS data_quality, n AS actual_items,
      nullif(concat_ws(', ', CASE WHEN no_condition > 0 THEN no_condition || ' items missing condition' END,
        CASE WHEN no_shipping > 0 THEN no_shipping || ' items missing shipping' END), '') AS notes
    FROM counted""",
)
def catalog_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = CATALOG_FLOW.validated(from_table(catalog_pages(spark, sf_dir)))
    return done.select("page_id", "status", "validation.data_quality", "validation.actual_items", "validation.notes")


@query(
    "catalog_field_coverage",
    f"""WITH {CATALOG},
    paged AS (SELECT *, {_layout()} AS main FROM fields),
    totals AS (SELECT {_layout()} AS main, count(*) AS items FROM items GROUP BY ALL)
    SELECT main AS layout, field, count(*) AS with_field, count(*) AS with_value, items,
      count(*)::DOUBLE / items AS field_share, count(*)::DOUBLE / items AS value_share
    FROM paged JOIN totals USING (main) GROUP BY main, field, items""",
)
def catalog_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of the items of each layout has each field."""
    main = F.get(F.array(*map(F.lit, LAYOUTS)), (F.col("page_id") % len(LAYOUTS)).cast("int"))
    found = extracted(spark, sf_dir).withColumn("layout", main)
    return field_coverage(long_fields(found, "layout", "page_id"), ["layout"], ["page_id", "pos"])


@query(
    "catalog_cleaning",
    f"""WITH {CATALOG},
    blocks AS (
      SELECT page_id, pos, page_id % 7 = 3 AND pos < 2 AS apart, CASE layout
        WHEN 'list' THEN '<li class="hit"><img alt="1 > 0" src="' || image || '"><a title="a > b" href="' || link || '">' || title
          || '</a> <span class="price">' || price || '</span> <i>' || condition || '</i><span>' || rating || '</span><span>' || reviews || '</span>'
        WHEN 'cards' THEN '<h3><a href="' || link || '">' || title || '</a></h3><p class="price">' || price || '<p>Condition: ' || condition
          || '<p>Seller: ' || seller || '</p><p>Located in ' || place || '</p>'
        WHEN 'rows' THEN '<tr><td><a href="' || link || '">' || title || '</a><td>' || price || '</td><td>' || condition || '</td><td>' || place
          || '</td><td>' || warehouse || '</td></tr>'
        WHEN 'terms' THEN '<dt><a href="' || link || '">' || title || '</a></dt><dd>' || price || '</dd><dd class="date">' || date
          || '</dd><dd>Seller: ' || seller
        ELSE '<div class="item"><div class="pic"><img src="' || image || '"></div><div class="body"><a href="' || link || '">' || title
          || '</a><b>' || price || '</b><span class="brand-name">' || seller || '</span><span>' || shipping
          || '</span><a href="/cart">Add to cart</a></div></div>' END AS block
      FROM items),
    bodies AS (
      SELECT page_id, '<body>{_MENU}<h1>Catalog ' || page_id || '</h1><ul>'
        || coalesce(string_agg(block, '' ORDER BY pos) FILTER (apart), '') || '</ul>'
        || CASE {_layout()} {" ".join(f"WHEN '{n}' THEN '{a}'" for n, (a, _) in _AROUND.items())} END
        || coalesce(string_agg(block, '' ORDER BY pos) FILTER (NOT apart), '')
        || CASE {_layout()} {" ".join(f"WHEN '{n}' THEN '{b}'" for n, (_, b) in _AROUND.items())} END
        || '<p>&copy; shop</p>' AS body
      FROM blocks GROUP BY page_id)
    SELECT page_id, md5(body) AS clean_md5, length(body) AS clean_chars, 5 AS removed_tags, 1 AS removed_comments FROM bodies""",
)
def catalog_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested noise goes whole, quoted `>` stay: what is left is what the page was made of."""
    cleaned = CATALOG_FLOW.clean(from_table(catalog_pages(spark, sf_dir)))
    return cleaned.select("page_id", F.md5("clean_html").alias("clean_md5"), "clean_chars", "removed_tags", "removed_comments")


@query(
    "catalog_statistics",
    f"""WITH {CATALOG},
    tagged AS (SELECT *, {_layout()} AS main FROM items),
    places AS (
      SELECT main, place, count(*) AS n, row_number() OVER (PARTITION BY main ORDER BY count(*) DESC, place) AS rank
      FROM tagged WHERE layout IN ('cards', 'rows') GROUP BY main, place)
    SELECT main AS layout, count(*) AS items, count(*) AS priced, min(amount) AS price_min, max(amount) AS price_max,
      quantile_disc(amount, 0.5) AS price_median, round(avg(1.5 + (substr(rating, 1, 1)::INT - 1)) FILTER (layout = 'list'), 9) AS avg_rating,
      sum(substr(reviews, 2, length(reviews) - 2)::DOUBLE) FILTER (layout = 'list') AS reviews,
      min('2025-12-' || substr(date, 5, 2) || ' 10:00') FILTER (layout = 'terms') AS first_date,
      max('2025-12-' || substr(date, 5, 2) || ' 10:00') FILTER (layout = 'terms') AS last_date,
      any_value(p.place) AS top_place, any_value(p.n) AS top_place_items
    FROM tagged LEFT JOIN (SELECT main, place, n FROM places WHERE rank = 1) p USING (main) GROUP BY main""",
)
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, ratings, dates and places over all items of a layout."""
    main = F.get(F.array(*map(F.lit, LAYOUTS)), (F.col("page_id") % len(LAYOUTS)).cast("int"))
    found = extracted(spark, sf_dir).withColumn("layout", main).select("layout", F.explode("items").alias("item"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return listing_statistics(found, ["layout"], F.lit("2025")).select(
        "layout", "items", "priced", "price_min", "price_max", "price_median", F.round("avg_rating", 9).alias("avg_rating"),
        "reviews", shown("first_date"), shown("last_date"), "top_place", "top_place_items",
    )


@query(
    "catalog_insights",
    f"""WITH {CATALOG},
    conditions AS (
      SELECT page_id, 'Conditions: ' || string_agg(n || ' ' || condition, ', ' ORDER BY condition) AS told FROM (
        SELECT page_id, condition, count(*) AS n FROM items WHERE layout IN ('list', 'cards', 'rows') GROUP BY ALL) GROUP BY page_id),
    places AS (
      SELECT page_id, 'Most from: ' || arg_min(place, struct_pack(x := -n, y := place)) || ' (' || max(n) || ' of ' || sum(n) || ')' AS told
      FROM (SELECT page_id, place, count(*) AS n FROM items WHERE layout IN ('cards', 'rows') GROUP BY ALL) GROUP BY page_id),
    dates AS (
      SELECT page_id, 'Dated: ' || min(date) || ' - ' || max(date) AS told FROM items WHERE layout = 'terms' GROUP BY page_id),
    counted AS (
      SELECT page_id, count(*) AS n, 'Price range: ' || min(amount) || ' - ' || max(amount) || ', median ' || quantile_disc(amount, 0.5)
        || ' (' || count(*) || ' priced)' AS prices FROM items GROUP BY page_id),
    filled AS (SELECT page_id, 'Fields: ' || count(*) || ' of ' || count(*) || ' filled' AS told FROM fields GROUP BY page_id)
    SELECT page_id, n || ' items from shop.example.com (category listing).' AS executive_summary, prices AS key_metrics,
      concat_ws('; ', f.told, prices, c.told, d.told, p.told) AS key_findings
    FROM counted JOIN filled f USING (page_id) LEFT JOIN conditions c USING (page_id) LEFT JOIN dates d USING (page_id)
      LEFT JOIN places p USING (page_id)""",
)
def catalog_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says about its items: prices, conditions, dates and the most frequent place."""
    done = CATALOG_FLOW.validated(from_table(catalog_pages(spark, sf_dir)))
    return done.select("page_id", "insights.executive_summary", "statistics.key_metrics", "insights.key_findings")
