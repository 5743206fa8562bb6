"""SQL twins of the page views: markup read with regular expressions and window functions.

The fragments below are written for the markup of the test tables: attributes in double quotes, balanced elements, named
references of five kinds besides numeric ones. They share nothing with the parser that they are compared with.
"""

from __future__ import annotations

from adlens.operators.html import CTA_WORDS

#: White space as a reader of Unicode text sees it.
_WS = r"[\s\x{85}\x{a0}\x{1c}-\x{1f}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def attribute(tag: str, name: str) -> str:
    """Value of an attribute in double quotes, null where the tag has none."""
    return f"CASE WHEN regexp_matches({tag}, '(?i)\\s{name}=\"') THEN {shown(f'''regexp_extract({tag}, '(?i)\\s{name}="([^"]*)"', 1)''')} END"


def shown(x: str) -> str:
    """Character references read."""
    numeric = f"list_reduce(list_prepend({x}, list_distinct(regexp_extract_all({x}, '&#[0-9]+;'))), lambda a, b: replace(a, b, chr(CAST(regexp_extract(b, '[0-9]+') AS INTEGER))))"
    return f"replace(replace(replace(replace(replace({numeric}, '&nbsp;', chr(160)), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


TOKENS = r"""src AS (SELECT page_id, html, html IS NOT NULL AS ok FROM pages),
cut AS (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[a-zA-Z/!][^>]*>|[^<]+|<') AS toks FROM src WHERE ok),
tok AS (SELECT page_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM cut),
kind AS (SELECT page_id, i, t, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, starts_with(t, '</') AS ends, NOT regexp_matches(t, '^<[a-zA-Z/!]') AS is_text FROM tok
 WHERE NOT regexp_matches(t, '(?i)^<(script|style)\b|^<!')),
deep AS (SELECT *,
 sum(CASE WHEN tag IN ('noscript', 'template', 'svg') THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS hidden,
 sum(CASE WHEN tag IN ('noscript', 'template') THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS unheard,
 sum(CASE WHEN tag = 'title' THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS titled,
 sum(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS headed,
 count(*) FILTER (WHERE tag IN ('h1', 'h2', 'h3') AND NOT ends) OVER w AS heading
 FROM kind WINDOW w AS (PARTITION BY page_id ORDER BY i))""" + f""",
said AS (SELECT *, {shown('t')} AS said FROM deep WHERE is_text),
metas AS (SELECT page_id, i, lower(coalesce({attribute('t', 'name')}, '')) AS name, lower(coalesce({attribute('t', 'property')}, '')) AS property, {attribute('t', 'content')} AS content FROM kind WHERE tag = 'meta'),
described AS (SELECT page_id, arg_min(trim(coalesce(content, '')), i) FILTER (WHERE trim(coalesce(content, '')) <> '') AS description FROM metas WHERE name = 'description' OR property = 'og:description' GROUP BY page_id),
starts AS (SELECT page_id, heading, tag FROM deep WHERE tag IN ('h1', 'h2', 'h3') AND NOT ends),
heads AS (SELECT page_id, heading, min(s.i) AS i, any_value(starts.tag) AS tag, {flat("string_agg(said, ' ' ORDER BY s.i)")} AS head FROM said s JOIN starts USING (page_id, heading) WHERE headed > 0 AND hidden = 0 AND titled = 0 GROUP BY page_id, heading),
titles AS (SELECT page_id, {flat("string_agg(said, '' ORDER BY i)")} AS title FROM said WHERE titled > 0 AND hidden = 0 GROUP BY page_id),
bodies AS (SELECT page_id, {flat("string_agg(said, ' ' ORDER BY i)")} AS body FROM said WHERE titled = 0 AND hidden = 0 GROUP BY page_id),
headings AS (SELECT page_id, count(*) FILTER (WHERE tag = 'h1') AS h1, count(*) FILTER (WHERE tag = 'h2') AS h2,
 coalesce(list(head ORDER BY tag, i) FILTER (WHERE head <> ''), []) AS all_heads FROM heads WHERE head <> '' GROUP BY page_id),
content AS (SELECT page_id, ok, CASE WHEN ok THEN coalesce(title, '') END AS title, CASE WHEN ok THEN coalesce(description, '') END AS description,
 CASE WHEN ok THEN CAST(coalesce(h1, 0) AS INTEGER) END AS h1, CASE WHEN ok THEN CAST(coalesce(h2, 0) AS INTEGER) END AS h2, coalesce(all_heads, []) AS all_heads, CASE WHEN ok THEN coalesce(body, '') END AS body,
 CASE WHEN ok THEN CAST(len(regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS INTEGER) END AS words
 FROM src LEFT JOIN titles USING (page_id) LEFT JOIN described USING (page_id) LEFT JOIN headings USING (page_id) LEFT JOIN bodies USING (page_id))"""

LINKS = f"""{TOKENS},
linked AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, href FROM (SELECT page_id, i, {attribute('t', 'href')} AS href FROM kind WHERE tag = 'a' AND NOT ends) WHERE coalesce(href, '') <> '')"""


def _fold(x: str) -> str:
    return f"lower(strip_accents(replace(replace(replace(replace(replace(replace(translate(coalesce({x}, ''), 'łŁđĐøØðÐħĦıİ', 'lLdDoOddhhii'), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'ae'), 'œ', 'oe'), 'Œ', 'oe'), 'þ', 'th')))"


_MET = f"""page AS (SELECT page_id, {_fold('body')} AS body, {_fold('title')} AS title, {_fold("array_to_string(all_heads, ' ' || chr(10) || ' ')")} AS heads FROM content WHERE ok),
kw AS (SELECT regexp_extract_all(trim(regexp_replace(strip_accents(translate(lower(text), 'łđø', 'ldo')), '\\s+', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM keywords WHERE text IS NOT NULL),
pair AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS keyword FROM (SELECT w, unnest(range(1, len(w))) AS i FROM kw)),
phrase AS (SELECT keyword, {_fold('keyword')} AS p FROM pair)"""


def _times(text: str) -> str:
    return f"CASE WHEN contains({text}, p) THEN len(regexp_extract_all({text}, '\\b' || regexp_escape(p) || '\\b')) ELSE 0 END"


_BLOCKS = "p div section article header footer li ul ol tr table br h1 h2 h3 h4 h5 h6 blockquote pre figure nav main aside".split()
_TEXT = f"""parts AS (SELECT d.page_id, d.i, CASE WHEN is_text THEN CASE WHEN hidden = 0 AND titled = 0 THEN {shown('t')} ELSE '' END WHEN tag IN ({', '.join(repr(b) for b in _BLOCKS)}) THEN chr(10) ELSE '' END AS p FROM deep d),
joined AS (SELECT page_id, regexp_split_to_array(string_agg(p, '' ORDER BY i), '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS lines FROM parts GROUP BY page_id),
text AS (SELECT page_id, array_to_string(list_filter([regexp_replace(regexp_replace(x, '[ \\t\\x{{a0}}]+', ' ', 'g'), '^{_WS}|{_WS}$', '', 'g') for x in lines], lambda x: x <> ''), chr(10)) AS text FROM joined)"""

_LD = r"""blocks AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script\s*>', 1)) AS block FROM src WHERE ok),
ld AS (SELECT page_id, trim(block) AS block FROM blocks WHERE trim(block) <> ''),
found AS (SELECT page_id, json_valid(block) AS fine, block FROM ld)"""

_CLICKS = f"""whole AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS html FROM src WHERE ok),
held AS (SELECT page_id, regexp_extract_all(html, '(?is)<(?:a|button)\\b[^>]*>.*?</(?:a|button)\\s*>|<h1\\b[^>]*>.*?</h1\\s*>|<h2\\b[^>]*>.*?</h2\\s*>|<title\\b[^>]*>.*?</title\\s*>') AS e FROM whole),
element AS (SELECT page_id, unnest(e) AS e, generate_subscripts(e, 1) AS i FROM held),
labelled AS (SELECT page_id, i, lower(regexp_extract(e, '^<([a-zA-Z0-9]+)', 1)) AS tag, {flat(shown("regexp_replace(e, '<[a-zA-Z/!][^>]*>', '', 'g')"))} AS label FROM element),
word AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{w}')" for n, w in enumerate(sorted(set(CTA_WORDS), key=lambda w: (-len(w), w))))}) AS v(n, word)),
call AS (SELECT page_id, i, label, arg_min(word, n) AS word FROM labelled JOIN word ON contains(lower(label), word) AND CASE WHEN contains(lower(label), word) THEN regexp_matches(label, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || word || '($|[^\\p{{L}}\\p{{N}}_])') END
 WHERE tag IN ('a', 'button') AND length(label) BETWEEN 1 AND 60 GROUP BY page_id, i, label),
once AS (SELECT page_id, lower(label) AS low, arg_min(label, i) AS label, min(i) AS i FROM call GROUP BY page_id, lower(label)),
samples AS (SELECT page_id, list(label ORDER BY i) AS samples FROM once GROUP BY page_id),
calls AS (SELECT page_id, CAST(count(*) AS INTEGER) AS ctas, list_sort(list_distinct(list(word))) AS words FROM call GROUP BY page_id)"""

_AUDIT = f"""spoken AS (SELECT page_id, CAST(len(regexp_extract_all({flat("string_agg(said, ' ' ORDER BY i)")}, '[\\p{{L}}\\p{{N}}_''-]*[\\p{{L}}\\p{{N}}_](?:[''-]*[\\p{{L}}\\p{{N}}_])*')) AS INTEGER) AS words
 FROM said WHERE titled = 0 AND unheard = 0 AND trim(said, ' ' || chr(10) || chr(9) || chr(160)) <> '' GROUP BY page_id),
roles AS (SELECT page_id, arg_min(label, i) FILTER (WHERE tag = 'title' AND label <> '') AS title, coalesce(list(label ORDER BY i) FILTER (WHERE tag = 'h1' AND label <> ''), []) AS h1, coalesce(list(label ORDER BY i) FILTER (WHERE tag = 'h2' AND label <> ''), []) AS h2 FROM labelled GROUP BY page_id),
tags AS (SELECT page_id, arg_min({attribute('t', 'lang')}, i) FILTER (WHERE tag = 'html') AS lang, CAST(count(*) FILTER (WHERE tag = 'img') AS INTEGER) AS images,
 CAST(count(*) FILTER (WHERE tag = 'img' AND trim(coalesce({attribute('t', 'alt')}, '')) = '') AS INTEGER) AS images_no_alt,
 arg_min({attribute('t', 'href')}, i) FILTER (WHERE tag = 'link' AND contains(lower(coalesce({attribute('t', 'rel')}, '')), 'canonical')) AS canonical FROM kind WHERE NOT ends AND NOT is_text GROUP BY page_id),
said_once AS (SELECT page_id, arg_min(trim(content), i) FILTER (WHERE name = 'description' AND coalesce(content, '') <> '') AS description, arg_min(trim(content), i) FILTER (WHERE name = 'robots' AND coalesce(content, '') <> '') AS robots, bool_or(name = 'viewport') AS viewport FROM metas GROUP BY page_id),
lds AS (SELECT page_id, list(block) AS blocks, count(*) AS n, list_sort(list_distinct(flatten(list(CASE WHEN fine THEN json_extract_string(block, '$..@type') ELSE regexp_extract_all(block, '"@type"\\s*:\\s*"([^"]+)"', 1) END)))) AS types FROM found GROUP BY page_id),
audit AS (SELECT page_id, ok, final_url, tags.lang, roles.title, said_once.description, said_once.robots, CASE WHEN ok THEN coalesce(viewport, false) END AS viewport, canonical, CASE WHEN ok THEN coalesce(roles.h1, []) END AS h1, CASE WHEN ok THEN coalesce(roles.h2, []) END AS h2,
 CASE WHEN ok THEN coalesce(images, 0) END AS images, CASE WHEN ok THEN coalesce(images_no_alt, 0) END AS images_no_alt, CASE WHEN ok THEN coalesce(lds.blocks, []) END AS ld_blocks, CASE WHEN ok THEN coalesce(spoken.words, 0) END AS words, CASE WHEN ok THEN coalesce(lds.types, []) END AS ld_types,
 CASE WHEN ok THEN coalesce(ctas, 0) END AS ctas, CASE WHEN ok THEN coalesce(calls.words, []) END AS cta_words, CASE WHEN ok THEN coalesce(samples, []) END AS cta_samples
 FROM src JOIN (SELECT page_id, final_url FROM pages) USING (page_id) LEFT JOIN tags USING (page_id) LEFT JOIN roles USING (page_id) LEFT JOIN said_once USING (page_id) LEFT JOIN lds USING (page_id) LEFT JOIN spoken USING (page_id) LEFT JOIN calls USING (page_id) LEFT JOIN samples USING (page_id))"""

_PRODUCT = """first AS (SELECT page_id, block AS p FROM (SELECT *, row_number() OVER (PARTITION BY page_id) AS r FROM found WHERE fine AND lower(json_extract_string(block, '$."@type"')) = 'product') WHERE r = 1),
numbered AS (SELECT page_id, row_number() OVER (PARTITION BY page_id) AS b, json_extract_string(block, '$..@type') AS names FROM found WHERE fine),
named AS (SELECT page_id, name, min(b * 1000 + place) AS place FROM (SELECT page_id, b, unnest(names) AS name, generate_subscripts(names, 1) AS place FROM numbered) GROUP BY page_id, name),
typed AS (SELECT page_id, string_agg(name, ',' ORDER BY place) AS bag FROM named GROUP BY page_id),
product AS (SELECT page_id, p, p IS NOT NULL AS found, json_extract(p, '$.offers') AS offer FROM src LEFT JOIN first USING (page_id) WHERE ok)"""


def _lacks(path: str, name: str, of: str = "p") -> str:
    return f"CASE WHEN coalesce(json_extract_string({of}, '$.{path}'), '') = '' THEN '{name}' END"


SQL = {
    "t1_content": f"WITH {TOKENS} SELECT page_id, ok, title, description, h1, h2, words FROM content",
    "t1_titles": f"WITH {TOKENS} SELECT page_id, title FROM content WHERE ok",
    "t2_audit": f"WITH {TOKENS}, {_LD}, {_CLICKS}, {_AUDIT} SELECT * EXCLUDE (final_url) FROM audit",
    "t3_text": f"WITH {TOKENS}, {_TEXT} SELECT page_id, CASE WHEN ok THEN coalesce(text, '') END AS text, CASE WHEN ok THEN sha256(coalesce(text, '')) END AS hash FROM src LEFT JOIN text USING (page_id)",
    "t4_links": f"WITH {LINKS} SELECT page_id, pos, href FROM linked",
    "c3_coverage": f"WITH {TOKENS}, {_MET}, n AS (SELECT page_id, keyword, CAST({_times('body')} AS INTEGER) AS count, {_times('title')} > 0 AS in_title, {_times('heads')} > 0 AS in_headings FROM page, phrase WHERE contains(body, p) OR contains(title, p) OR contains(heads, p)) SELECT * FROM n WHERE count > 0 OR in_title OR in_headings",
    "c3_matrix": f"WITH {TOKENS}, {_MET}, few AS (SELECT keyword, {_fold('keyword')} AS p FROM (VALUES ('rain jacket'), ('kask rowerowy'), ('sac à dos'), ('bürostuhl'), ('not there at all')) AS v(keyword)) SELECT page_id, keyword, CAST({_times('body')} AS INTEGER) AS count, {_times('title')} > 0 AS in_title, {_times('heads')} > 0 AS in_headings FROM page, few",
    "c4_gaps": f"WITH {TOKENS}, {_MET}, n AS (SELECT keyword, count(*) FILTER (WHERE {_times('body')} = 0) AS pages FROM page, phrase GROUP BY keyword) SELECT * FROM n WHERE pages > 0",
    "d1_structured_data": f"""WITH {TOKENS}, {_LD}, {_PRODUCT}
SELECT page_id, found, coalesce(bag, '') AS types,
 CASE WHEN NOT found THEN 'name,image,offers' ELSE array_to_string(list_filter([{_lacks('name', 'name')}, {_lacks('image', 'image')}, CASE WHEN offer IS NULL THEN 'offers' END, CASE WHEN offer IS NOT NULL THEN {_lacks('price', 'offers.price', 'offer')} END,
  CASE WHEN offer IS NOT NULL THEN {_lacks('priceCurrency', 'offers.priceCurrency', 'offer')} END, CASE WHEN offer IS NOT NULL THEN {_lacks('availability', 'offers.availability', 'offer')} END], lambda x: x IS NOT NULL), ',') END AS missing,
 CASE WHEN NOT found THEN 'description,brand,identifier' ELSE array_to_string(list_filter([{_lacks('description', 'description')}, {_lacks('brand', 'brand')}, CASE WHEN coalesce({', '.join(f"json_extract_string(p, '$.{x}')" for x in ('sku', 'mpn', 'gtin', 'gtin8', 'gtin12', 'gtin13', 'gtin14'))}, '') = '' THEN 'sku/mpn/gtin' END], lambda x: x IS NOT NULL), ',') END AS advised
FROM product LEFT JOIN typed USING (page_id)""",
    "d3_types": f"WITH {TOKENS}, {_LD}, t AS (SELECT DISTINCT page_id, unnest(json_extract_string(block, '$..@type')) AS type FROM found WHERE fine) SELECT type, count(*) AS pages FROM t GROUP BY type",
    "l1_images": f"WITH {TOKENS}, {_LD}, {_CLICKS}, {_AUDIT} SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS site, CAST(sum(images) AS BIGINT) AS images, CAST(sum(images_no_alt) AS BIGINT) AS images_no_alt FROM audit JOIN (SELECT page_id, url FROM pages) USING (page_id) GROUP BY 1",
    "l2_calls": f"WITH {TOKENS}, {_LD}, {_CLICKS}, {_AUDIT} SELECT page_id, ctas, array_to_string(cta_words, ',') AS words, list_slice(cta_samples, 1, 10) AS samples FROM audit WHERE ok",
    "l4_flags": f"""WITH {TOKENS}, {_LD}, {_CLICKS}, {_AUDIT},
f AS (SELECT unnest([CASE WHEN NOT coalesce(starts_with(final_url, 'https://'), false) THEN 'not HTTPS' END,
 CASE WHEN length(coalesce(title, '')) = 0 THEN 'missing title' WHEN length(title) > 60 THEN 'title too long (>60)' END,
 CASE WHEN length(coalesce(description, '')) = 0 THEN 'no meta description' WHEN length(description) < 50 THEN 'meta description too short' WHEN length(description) > 160 THEN 'meta description too long (>160)' END,
 CASE WHEN len(h1) = 0 THEN 'missing H1' WHEN len(h1) > 1 THEN 'multiple H1' END, CASE WHEN NOT viewport THEN 'no viewport (not mobile-friendly)' END,
 CASE WHEN coalesce(lang, '') = '' THEN 'no html lang attribute' END, CASE WHEN len(ld_blocks) = 0 THEN 'no structured data' END, CASE WHEN words < 200 THEN 'thin content (<200 words)' END,
 CASE WHEN images > 0 AND images_no_alt > 0 THEN 'images without alt (' || images_no_alt || '/' || images || ')' END, CASE WHEN ctas = 0 THEN 'no clear call-to-action detected' END,
 CASE WHEN contains(lower(coalesce(robots, '')), 'noindex') THEN 'page is noindex' END]) AS flag FROM audit WHERE ok)
SELECT flag, count(*) AS pages FROM f WHERE flag IS NOT NULL GROUP BY flag""",
    "c1_summary": f"WITH {TOKENS} SELECT count(*) FILTER (WHERE ok) AS ok_pages, count(*) FILTER (WHERE NOT ok) AS failed, coalesce(min(words), 0) AS min_words, coalesce(max(words), 0) AS max_words, coalesce(round_even(avg(words), 0), 0.0) AS mean_words FROM content",
}
