"""The page flow in plain SQL: common table expressions that the oracles of the page queries share."""

from __future__ import annotations

# The patterns of the oracle are its own: plain regular expressions, where the engine reads tags one by one. They hold
# for pages without `>` in attribute values and without noise nested in its own kind.
TAIL = r"(?:[\s/][^>]*)?(?:>|\z)"
SPAN = r".*?(?:</{0}\s*>|\z)"
NOISE_OPENING = rf"(?i)<(?:script|style|svg|path|noscript|iframe|meta|link){TAIL}"
NOISE = (
    r"(?is)<(?:!--.*?(?:-->|\z)|(?:svg|noscript|iframe)(?:\s[^>]*)?/>|"
    + "|".join(name + TAIL + SPAN.format(name) for name in ("script", "style", "svg", "noscript", "iframe"))
    + rf"|/?(?:path|meta|link){TAIL})"
)
INLINE_IMAGE = (
    r"""(<[iI][mM][gG](?:[\s/][^<>]*?)?\s[sS][rR][cC]\s*=\s*)"""
    r"""(?:"data:image[^"]*"|'data:image[^']*'|data:image[^\s>]*)"""
)
BODY_START = rf"(?is)<body{TAIL}.*"
BODY_END = r"(?i)</body\s*>"
TITLE = rf"(?i)<title{TAIL}([^<]*)"
HEADING_1 = rf"(?is)<h1{TAIL}(.*?)(?:</h1\s*>|\z)"
HEADING_ENTRY = rf"(?i)<h1{TAIL}"
LIST_ENTRY = rf"(?i)<li{TAIL}"
ENTRY_END = r"(?i)</(?:li|ul|ol)\s*>"
ANCHOR = r"(?is)<a\s[^>]*(?:>|\z).*?(?:</a\s*>|\z)"
ANCHOR_TAG = r"(?is)^<a\s[^>]*"
SITE = r"^https?://(?:www\.|m\.|blog\.)?([^/?#]+)"
AMOUNT = r"(?:US )?[$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?"
PRICED = r"[$€£]\s?[0-9]"
AUCTION = r"auction|\bbids?\b"
SEARCH_URL = r"[?&](?:q|s|query|search)="
PAGED_URL = r"[?&]page=[0-9]"
FIRST_SEGMENT = r"^https?://[^/?#]+/([^/?#]+)"


def q(pattern: str) -> str:
    """A text as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def plain(text: str) -> str:
    bare = f"regexp_replace({text}, '<[^<>]*>', '', 'g')"
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&euro;", "€"), ("&pound;", "£"),
        ("&#34;", '"'), ("&#36;", "$"), ("&#38;", "&"), ("&#39;", "'"), ("&#60;", "<"), ("&#62;", ">"),
        ("&#160;", "\xa0"), ("&#163;", "£"), ("&#8364;", "€"), ("&amp;", "&"),
    ):
        bare = f"replace({bare}, {q(entity)}, {q(char)})"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


def attribute(tag: str, name: str) -> str:
    start = rf"(?is)\s{name}\s*=\s*"
    choices = (rf'{start}"([^"]*)"', rf"{start}'([^']*)'", rf"{start}([^\s\"'>]+)")
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({tag}, {q(c)}, 1), '')" for c in choices) + ")"


def cleaned_cte(source: str = "pages", min_bytes: int = 1000, prefix: str = "") -> str:
    return f"""
{prefix}scanned AS (
  SELECT *, strlen(html) AS size_bytes, length(html) AS original_chars,
         CASE WHEN html IS NULL THEN 'no_content' WHEN strlen(html) < {min_bytes} THEN 'too_small'
              WHEN length(html) < 100 THEN 'short_raw' END AS raw_reason
  FROM {source}),
{prefix}stripped AS (
  SELECT *, CASE WHEN raw_reason IS NULL THEN regexp_extract_all(html, {q(NOISE)}) END AS blocks,
         CASE WHEN raw_reason IS NULL THEN regexp_replace(html, {q(NOISE)}, '', 'g') END AS txt
  FROM {prefix}scanned),
{prefix}masked AS (
  SELECT *, len(regexp_extract_all(txt, {q(INLINE_IMAGE)})) AS base64_images_removed,
         regexp_replace(txt, {q(INLINE_IMAGE)}, '\\1"[BASE64_REMOVED]"', 'g') AS masked_html
  FROM {prefix}stripped),
{prefix}bodied AS (
  SELECT *, coalesce(nullif(regexp_extract(regexp_split_to_array(masked_html, {q(BODY_END)})[1],
                                           {q(BODY_START)}), ''), masked_html) AS body_html
  FROM {prefix}masked),
{prefix}cleaned AS (
  SELECT * EXCLUDE (txt, masked_html, body_html, raw_reason),
         coalesce(raw_reason, CASE WHEN length(body_html) < 50 THEN 'short_clean' END) AS reason,
         CASE WHEN length(body_html) >= 50 THEN body_html END AS clean_html,
         CASE WHEN blocks IS NOT NULL THEN coalesce(list_sum(list_transform(blocks, lambda b:
           CASE WHEN starts_with(b, '<!--') THEN 0
                WHEN regexp_matches(b, '(?i)^<(?:script|style)') THEN 1
                ELSE len(regexp_extract_all(b, {q(NOISE_OPENING)})) END)), 0)::BIGINT END AS removed_tags,
         len(list_filter(blocks, lambda b: starts_with(b, '<!--'))) AS removed_comments
  FROM {prefix}bodied)"""


HOST = f"nullif(regexp_extract(url, {q(SITE)}, 1), '')"

CLEANED = cleaned_cte()

PROFILED = f"""{CLEANED},
features AS (
  SELECT *, nullif({plain(f"regexp_extract(html, {q(TITLE)}, 1)")}, '') AS title,
         len(regexp_extract_all(clean_html, {q(LIST_ENTRY)})) AS li,
         len(regexp_extract_all(clean_html, {q(HEADING_ENTRY)})) AS h1,
         regexp_matches(clean_html, {q(PRICED)}) AS priced
  FROM cleaned WHERE reason IS NULL),
profiled AS (
  SELECT *,
    CASE WHEN regexp_matches(lower(concat_ws(' ', url, title)), {q(AUCTION)}) THEN 'auction'
         WHEN regexp_matches(lower(url), {q(SEARCH_URL)}) THEN 'search results'
         WHEN li >= 2 OR regexp_matches(lower(url), {q(PAGED_URL)}) THEN 'category listing'
         WHEN li = 1 OR h1 = 1 THEN 'single product' ELSE 'unknown' END AS page_type,
    coalesce({HOST}, 'Unknown') AS source,
    coalesce(nullif(regexp_extract(url, {q(FIRST_SEGMENT)}, 1), ''), '') AS category,
    CASE WHEN li >= 2 THEN 'multiple (estimate ' || li || ')' ELSE 'single' END AS item_count,
    CASE WHEN priced THEN 'title,link,price' ELSE 'title,link' END AS expected_fields,
    CASE WHEN li >= 3 THEN 'high' WHEN li >= 1 THEN 'medium' ELSE 'low' END AS confidence,
    li || ' list entries, ' || h1 || ' main headings, 0 structured items' AS notes
  FROM features)"""

# One row per item, pos from 0. The generated pages state no prices and carry no structured data.
ITEMS = f"""{PROFILED},
entries AS (
  SELECT page_id, part, n FROM (
    SELECT page_id, unnest(regexp_split_to_array(clean_html, {q(LIST_ENTRY)})[2:]) AS part,
           generate_subscripts(regexp_split_to_array(clean_html, {q(LIST_ENTRY)})[2:], 1) AS n
    FROM profiled)),
anchors AS (
  SELECT page_id, n, regexp_extract(entry, {q(ANCHOR)}) AS anchor, entry FROM (
    SELECT page_id, n, regexp_split_to_array(part, {q(ENTRY_END)})[1] AS entry FROM entries)),
linked AS (
  SELECT page_id, n, nullif({plain("anchor")}, '') AS title,
         {attribute(f"regexp_extract(anchor, {q(ANCHOR_TAG)})", "href")} AS link,
         nullif(regexp_extract({plain("entry")}, {q(AMOUNT)}), '') AS price
  FROM anchors),
from_links AS (
  SELECT p.page_id, row_number() OVER (PARTITION BY p.page_id ORDER BY n) - 1 AS pos,
         l.title, l.link, l.price, 'items' AS shape
  FROM linked l JOIN profiled p USING (page_id)
  WHERE l.title IS NOT NULL AND l.link IS NOT NULL AND p.item_count <> 'single'),
from_page AS (
  SELECT page_id, 0 AS pos,
         coalesce(nullif({plain(f"regexp_extract(clean_html, {q(HEADING_1)}, 1)")}, ''), title) AS title,
         url AS link, nullif(regexp_extract({plain("clean_html")}, {q(AMOUNT)}), '') AS price,
         CASE WHEN item_count = 'single' THEN 'item' ELSE 'items' END AS shape
  FROM profiled
  WHERE item_count = 'single' OR page_id NOT IN (SELECT page_id FROM from_links)),
items AS (
  SELECT * FROM from_links UNION ALL SELECT * FROM from_page WHERE title IS NOT NULL)"""

FIELDS = f"""{ITEMS},
fields AS (
  SELECT page_id, pos, 0 AS field_pos, 'title' AS field, title AS value, 'string' AS value_type FROM items
  UNION ALL SELECT page_id, pos, 1, 'link', link, 'string' FROM items WHERE link IS NOT NULL
  UNION ALL SELECT page_id, pos, 2, 'price', price, 'string' FROM items WHERE price IS NOT NULL)"""

# Pages with their items folded back: counts, rendering, extracted data.
RENDERED = f"""{ITEMS},
folded AS (
  SELECT page_id, count(*) AS n_items, any_value(shape) AS shape,
    count(*) + count(link) + count(price) AS total_fields,
    count_if(title IN ('', 'N/A')) + count_if(link IN ('', 'N/A')) + count_if(price IN ('', 'N/A')) AS missing,
    count_if(price IS NULL OR price IN ('', 'N/A')) AS no_price,
    arg_min(title, pos) AS first_title,
    string_agg('### Item ' || (pos + 1) || ': ' || title
      || coalesce(chr(10) || '- **Link:** ' || link, '')
      || coalesce(chr(10) || '- **Price:** ' || price, ''), chr(10) || chr(10) ORDER BY pos) AS blocks_md,
    arg_min('### ' || title || chr(10) || concat_ws(chr(10), '- **Link:** ' || link, '- **Price:** ' || price), pos)
      AS single_md,
    string_agg('{{"title":' || to_json(title)::VARCHAR || coalesce(',"link":' || to_json(link)::VARCHAR, '')
      || coalesce(',"price":' || to_json(price)::VARCHAR, '') || '}}', ',' ORDER BY pos) AS items_json
  FROM items GROUP BY page_id),
rendered AS (
  SELECT p.*, coalesce(f.n_items, 0) AS n_items, coalesce(f.shape, 'items') AS shape,
    coalesce(f.total_fields, 0) AS total_fields, coalesce(f.missing, 0) AS missing, f.first_title,
    coalesce(f.no_price, 0) AS no_price,
    CASE WHEN f.n_items IS NULL THEN ''
         WHEN f.shape = 'item' THEN '## Product Details' || chr(10) || chr(10) || f.single_md
         ELSE '## All Items Found' || chr(10) || chr(10) || f.blocks_md END AS formatted_markdown,
    CASE WHEN f.shape = 'item' THEN '{{"item":' || f.items_json || '}}'
         ELSE '{{"items":[' || coalesce(f.items_json, '') || ']}}' END AS extracted_data
  FROM profiled p LEFT JOIN folded f USING (page_id))"""

# The generated pages state no prices, so every item lacks price, condition and shipping.
VALIDATED = f"""{RENDERED},
measured AS (
  SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(item_count, '([0-9]+)', 1), '') AS BIGINT), 1) AS expected
  FROM rendered),
graded AS (
  SELECT *, n_items::DOUBLE / expected AS found,
    CASE WHEN total_fields > 0 THEN missing::DOUBLE / total_fields ELSE 0.0 END AS missing_share,
    concat_ws(', ', CASE WHEN no_price > 0 THEN no_price || ' items missing price' END,
                    CASE WHEN n_items > 0 THEN n_items || ' items missing condition' END,
                    CASE WHEN n_items > 0 THEN n_items || ' items missing shipping' END) AS gaps
  FROM measured),
validated AS (
  SELECT *,
    CASE WHEN found >= 0.9 THEN 'success' WHEN found > 0 THEN 'extraction_incomplete'
         ELSE 'extraction_failed' END AS status,
    CASE WHEN found >= 1 AND missing_share <= 0.15 THEN 'excellent' WHEN found >= 0.9 THEN 'good'
         WHEN found >= 0.5 THEN 'fair' ELSE 'poor' END AS data_quality
  FROM graded)"""

ALL_VALIDATED = f"""{VALIDATED},
every_page AS (
  SELECT c.page_id, c.url, c.reason, v.* EXCLUDE (page_id, url, reason, status),
         coalesce(v.status, 'extraction_failed') AS status,
         CASE WHEN v.status IN ('success', 'extraction_incomplete') THEN 'archive' ELSE 'errors' END AS disposition
  FROM cleaned c LEFT JOIN validated v USING (page_id))"""


def sanitized(text: str, sep: str) -> str:
    return f"left(replace(regexp_replace({text}, '[^a-zA-Z0-9\\s]', '', 'g'), ' ', '{sep}'), 30)"


def source_part(source: str) -> str:
    kept = f"left(coalesce(nullif(regexp_replace({source}, '[^a-zA-Z0-9]', '', 'g'), ''), 'Unknown'), 20)"
    return f"(upper(left({kept}, 1)) || lower(substr({kept}, 2)))"
