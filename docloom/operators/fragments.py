"""Small functions as queries: text repair, captions, notes, units, JSON, times, vectors and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.operators import documents, extraction, shaping
from docloom.plans import derived
from docloom.plans.book import Book, table
from docloom.plans.derived import ITEMS, TABLES, cte

BOOK = Book()
#: Characters of a note's piece, and parts of a caption label.
NOTE_CHARS = 900
CAPTION = r"(?i)^\s*(fig\.?|figure|table)\s+(\d+[\w.-]*)"


def merged(old: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects, keys of the patch last and values as they are; null if nothing comes of it.

    Values are kept as JSON text, so numbers, booleans and nested values do not change; what is no object counts as empty.
    """
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    value = lambda c, k: F.to_json(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")[k])
    pair = lambda c: F.transform(keys(c), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), value(c, k)))
    kept = F.filter(keys(old), lambda k: ~F.array_contains(keys(patch), k))
    first = F.transform(kept, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), value(old, k)))
    both = F.concat(first, pair(patch))
    return F.when(F.size(both) > 0, F.concat(F.lit("{"), F.array_join(both, ","), F.lit("}")))


def integer_key(json: Column, key: str) -> Column:
    """The value of a key if it is an integer, not text that looks like one."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get(v, f"$.{key}", "bigint"))


def caption_label(caption: Column) -> Column:
    """struct(kind, label) of a caption's beginning; null where it names nothing."""
    kind = F.when(F.lower(F.regexp_extract(caption, CAPTION, 1)) == "table", "table").otherwise("figure")
    return F.when(caption.rlike(CAPTION), F.struct(kind.alias("kind"), F.concat(F.initcap(kind), F.lit(" "), F.regexp_replace(F.regexp_extract(caption, CAPTION, 2), "[.-]+$", "")).alias("label")))


def markdown_cells(markdown: Column) -> Column:
    """Cells of the table lines of a Markdown text, without separator lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), text.strip), lambda s: s.startswith("|"))
    cells = F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), text.strip))
    return F.filter(cells, lambda row: ~F.forall(row, lambda c: c.rlike("^:?-{3,}:?$")))


def keywords(value: Column) -> Column:
    """Lower-case words and signs of a phrase, of 40 characters at most."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)[^\w一-鿿%·°\^\\-]+", " "), " "), lambda t: (t != "") & (F.length(t) <= 40))


def excerpt_of(body: Column, *wanted: Column, radius: int = 60, head: int = 180) -> Column:
    """The text around the first of the wanted phrases that stands in it, else its beginning."""
    out = None
    for token in wanted:
        clean = text.strip(F.coalesce(token, F.lit("")))
        at = F.instr(F.lower(body), F.lower(clean))
        start = F.greatest(F.lit(1), at - radius)
        cut = text.strip(F.substring(body, start, F.least(F.length(body), at - 1 + F.length(clean) + radius) - start + 1))
        hit = (clean != "") & (at > 0)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return F.coalesce(out.otherwise(text.strip(F.substring(body, 1, head))), F.lit(""))


def note_pieces(body: Column, most: int = NOTE_CHARS) -> Column:
    """Paragraphs packed into pieces of up to ``most`` characters, longer ones cut; an ordered fold over the paragraphs."""
    parts = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\n\s*\n"), text.strip), lambda p: p != "")
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.length(p), F.lit(most)), lambda i: F.substring(p, i, F.lit(most))))))
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))
    step = lambda s, p: F.when(s["held"] == "", F.struct(p.alias("held"), s["out"].alias("out"))).when(F.length(s["held"]) + 2 + F.length(p) <= most, F.struct(F.concat(s["held"], F.lit("\n\n"), p).alias("held"), s["out"].alias("out"))).otherwise(F.struct(p.alias("held"), F.array_append(s["out"], s["held"]).alias("out")))
    return F.aggregate(cut, start, step, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.array_append(s["out"], s["held"])))


def caption_candidates(page: Column, least: int = 20, most: int = 1200) -> Column:
    """Captions in the text of a page: from a label at a line's start to the next one or an empty line, the first of each label."""
    pattern = r"(?ims)^\s*((?:fig\.?|figure|table)\s*\d+[\s\S]*?)(?=\n\s*\n|^\s*(?:fig\.?|figure|table)\s*\d+|\z)"
    found = F.transform(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(pattern), F.lit(1)), text.collapse)
    found = F.filter(found, lambda c: F.length(c).between(least, most))
    label = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"(?i)^((?:fig\.?|figure|table)\s*\d+)", 1)), r"\s+", "")
    # Captions and labels are bound once each, not taken from the page again for every caption.
    first = lambda own, labels: F.filter(own, lambda c, i: F.array_position(labels, F.get(labels, i)) == i + 1)
    return F.transform(F.array(found), lambda own: F.transform(F.array(F.transform(own, label)), lambda labels: first(own, labels))[0])[0]


_EVENT_JSON = """CASE event_id % 6 WHEN 0 THEN '{"job_id": 7, "n": {"a": [1, 2]}}' WHEN 1 THEN '{"job_id": "7"}' WHEN 2 THEN '{"job_id": 2.5}' WHEN 3 THEN '{bad' WHEN 4 THEN '[1]' ELSE props END"""


@BOOK.add(f"""SELECT event_id, CASE WHEN json_valid(j) AND json_type(j, '$.job_id') IN ('UBIGINT','BIGINT') THEN CAST(json_extract_string(j, '$.job_id') AS BIGINT) END AS job_id FROM (SELECT event_id, {_EVENT_JSON} AS j FROM events)""")
def json3_integer_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_EVENT_JSON).alias("j")).select("event_id", integer_key(F.col("j"), "job_id").alias("job_id"))


@BOOK.add("""SELECT event_id, replace(replace(CASE event_id % 4 WHEN 0 THEN '{"a":{"x":1},"k":"new","z":null}' WHEN 1 THEN '{"k":' || json_extract_string(props, '$.k') || '}' WHEN 2 THEN '{"k":"new","z":null}' ELSE NULL END, ' ', ''), chr(10), '') AS merged FROM events""")
def json5_merge_patch_typed(spark, sf_dir):
    """Merge of JSON objects whose numbers, texts, nulls and nested values stay what they are (DML-10)."""
    old = F.when(F.col("event_id") % 4 == 0, '{"k": 5, "a": {"x": 1}}').when(F.col("event_id") % 4 == 1, F.col("props")).when(F.col("event_id") % 4 == 2, "[1, 2]")
    patch = F.when(F.col("event_id") % 2 == 0, '{"k": "new", "z": null}')
    return table(spark, sf_dir, "events").select("event_id", old.alias("old"), patch.alias("patch")).select("event_id", merged(F.col("old"), F.col("patch")).alias("merged"))


@BOOK.add("""SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","none":null}' AS dumped FROM events""")
def json6_safe_dump(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"}).alias("dumped"))


@BOOK.add("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 64 ELSE 0 END AS dim FROM embeddings""")
def arr6_vector_decode(spark, sf_dir):
    """Vectors kept as JSON text; one that is not all numbers is empty."""
    told = F.when(F.col("vec_id") % 3 == 0, F.to_json("embedding")).when(F.col("vec_id") % 3 == 1, '[0.1, "x"]').otherwise("none")
    vector = F.coalesce(F.from_json(told, "array<double>"), F.array().cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.when(F.exists(vector, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(vector)).alias("dim"))


@BOOK.add("""SELECT p_partkey AS id, array_to_string(list_filter([p_type, '', p_brand, p_type], lambda x, i: x <> '' AND i <> 4), '|') AS items, array_to_string(list_slice(string_split(p_name || ' ' || p_type || ' x y z', ' '), 1, 3), ' ') AS head FROM part""")
def arr1_distinct_and_prefix(spark, sf_dir):
    """Ordered distinct items without blanks (ARR-1), and the first of a list (ARR-9)."""
    items = F.array_distinct(F.filter(F.array("p_type", F.lit(""), "p_brand", "p_type"), lambda x: x != ""))
    head = F.slice(F.split(F.concat_ws(" ", "p_name", "p_type", F.lit("x y z")), " "), 1, 3)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(items, "|").alias("items"), F.array_join(head, " ").alias("head"))


@BOOK.add("""WITH t AS (SELECT p_partkey AS label, [p_name, p_type, p_brand] AS headers, [[p_size::VARCHAR, '-', 'a'], ['N/A', p_type]] AS rows FROM part), r AS (SELECT label, headers, unnest(range(len(rows))) AS row, unnest(rows) AS cells FROM t),
c AS (SELECT label, row, unnest(headers) AS header, unnest(list_transform(range(1, len(headers) + 1), lambda i: coalesce(cells[i], ''))) AS cell FROM r) SELECT label, CAST(row AS INTEGER) AS row, header, cell FROM c WHERE cell NOT IN ('', '-', '—', 'N/A')""")
def arr3_wide_to_long(spark, sf_dir):
    size = F.col("p_size").cast("string")
    rows = F.array(F.array(size, F.lit("-"), F.lit("a")), F.array(F.lit("N/A"), F.col("p_type")))
    return extraction.wide_to_long(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), F.array("p_name", "p_type", "p_brand").alias("headers"), rows.alias("rows")))


@BOOK.add("""WITH w AS (SELECT p_partkey % 10 AS page, p_size % 3 AS block, p_size % 5 AS line, (p_size * 7 % 300)::DOUBLE AS x0, (p_size * 3 % 40)::DOUBLE AS y0, p_partkey AS k FROM part)
SELECT page, block, line, min(x0) AS x0, min(y0) AS y0, max(x0) + 20 AS x1, max(y0) + 8 AS y1, string_agg('w' || k, ' ' ORDER BY x0, 'w' || k) AS text FROM w GROUP BY page, block, line, floor(y0 / 5)""")
def arr7_words_to_lines(spark, sf_dir):
    words = table(spark, sf_dir, "part").selectExpr("p_partkey % 10 AS page", "p_size % 3 AS block", "p_size % 5 AS line", "CAST(p_size * 7 % 300 AS DOUBLE) AS x0", "CAST(p_size * 3 % 40 AS DOUBLE) AS y0", "concat('w', p_partkey) AS word")
    return shaping.words_to_lines(words.select("*", (F.col("x0") + 20).alias("x1"), (F.col("y0") + 8).alias("y1")))


@BOOK.add("""SELECT doc_id, regexp_replace(replace(replace(t, 'ﬁ', 'fi'), 'ﬀ', 'ff'), '([a-zA-Zäöüß0-9_])-\\s*\\n\\s*([a-zA-Zäöüß0-9_])', '\\1\\2', 'g') AS repaired FROM (SELECT doc_id, 'ﬁrst eﬀort of re-' || chr(10) || ' search ' || lang AS t FROM documents)""".replace("\\\\", "\\"))
def str8_repair(spark, sf_dir):
    said = F.concat(F.lit("ﬁrst eﬀort of re-\n search "), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", text.repair(said).alias("repaired"))


@BOOK.add("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Body of ' || doc_id || '.' ELSE 'Body of ' || doc_id || '.' || chr(10) || 'and references' END AS body, CASE WHEN doc_id % 2 = 0 THEN '[1] ' || source END AS refs FROM documents""")
def str10_references(spark, sf_dir):
    said = F.concat(F.lit("Body of "), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n\n  References \n[1] "), "source")).otherwise("\nand references"))
    return table(spark, sf_dir, "documents").select("doc_id", text.references(said).alias("r")).select("doc_id", F.col("r.body").alias("body"), F.col("r.refs").alias("refs"))


@BOOK.add("""SELECT doc_id, 'Text before' || chr(10) || 'see Figure 2' AS body, 'Fig. ' || doc_id || ' Growth of cells' AS captions FROM documents""")
def str11_caption_lines(spark, sf_dir):
    said = F.concat(F.lit("Text before\n Fig. "), F.col("doc_id").cast("string"), F.lit(" Growth of cells\nsee Figure 2"))
    return table(spark, sf_dir, "documents").select("doc_id", text.captions(said).alias("c")).select("doc_id", F.col("c.body").alias("body"), F.array_join("c.captions", "|").alias("captions"))


@BOOK.add(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1␞', 'g'), '␞|\n+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) AS INTEGER) AS n FROM documents""")
def str14_claim_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(text.claim_sentences(F.col("text")), lambda s: s != "")).alias("n"))


@BOOK.add("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' END AS kind, CASE p_size % 3 WHEN 0 THEN 'Figure ' || p_partkey WHEN 1 THEN 'Table ' || p_size || 'b' END AS label FROM part""")
def str16_caption_label(spark, sf_dir):
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" Fig. "), F.col("p_partkey").cast("string"), F.lit(". growth"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("TABLE  "), F.col("p_size").cast("string"), F.lit("b: sizes"))).otherwise("see Figure 1")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), caption_label(said).alias("c")).select("id", "c.kind", "c.label")


@BOOK.add("""SELECT p_partkey AS id, ['Pa·s','s⁻¹','min⁻¹','mPa·s','kg','% v/v',''][p_size % 7 + 1] AS unit FROM part""")
def str19_unit(spark, sf_dir):
    told = F.element_at(F.array(*(F.lit(s) for s in (" Pa s", "S^-1", "min -1", "mPa * s", "k g", "% v/v ", ""))), (F.col("p_size") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.unit(told).alias("unit"))


@BOOK.add(r"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_%·°^\\-]+', ' ', 'g'), ' '), lambda t: t <> '' AND length(t) <= 40), ' ') AS keywords FROM benchmark""")
def str20_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


@BOOK.add("""SELECT p_partkey AS id, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | x\\|y |' || chr(10) || '| 1 |  |' AS markdown FROM part""".replace("\\\\", "\\"))
def str22_table_markdown(spark, sf_dir):
    rows = F.array(F.array(F.col("p_name"), F.lit("x|y")), F.array(F.lit("1")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), shaping.table_markdown(F.array(F.lit("a"), F.lit("b")), rows).alias("markdown"))


@BOOK.add("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size END AS asset_id FROM part""")
def str30_scope_marker(spark, sf_dir):
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("growth [IMAGE_ASSET_SCOPE asset_id="), F.col("p_size").cast("string"), F.lit("] rate"))).otherwise("growth asset_id=3")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.nullif(F.regexp_extract(said, r"\[IMAGE_ASSET_SCOPE asset_id=(\d+)", 1), F.lit("")).try_cast("int").alias("asset_id"))


@BOOK.add(r"""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN regexp_replace(substr(text, greatest(1, instr(lower(text), 'license') - 60), least(length(text), instr(lower(text), 'license') + 66) - greatest(1, instr(lower(text), 'license') - 60) + 1), '^\s+|\s+$', '', 'g') ELSE regexp_replace(substr(text, 1, 180), '^\s+|\s+$', '', 'g') END AS excerpt FROM documents""")
def str32_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", excerpt_of(F.col("text"), F.lit(" "), F.lit("License ")).alias("excerpt"))


@BOOK.add("""SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['Fig. 1 growth of all of the cells ' || source, 'Table 2 sizes of each of the parts'] ELSE [] END, '|') AS captions FROM documents""")
def str33_caption_candidates(spark, sf_dir):
    page = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Intro text\nFig. 1 growth of all\n of the cells "), "source", F.lit("\nTable 2 sizes of each of the parts\n\nmore text\nfig.1 the same label once more, later\n\nTable 3 short"))).otherwise("see Fig. 1 in the text of this page")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(caption_candidates(page), "|").alias("captions"))


@BOOK.add(f"""WITH {cte('t', TABLES)} SELECT id, CASE WHEN contains(content, '| Name') THEN 'Name,Size' ELSE '' END AS headers, CASE WHEN contains(content, '| Name') THEN 2 ELSE 0 END AS n_rows FROM t""")
def str34_table_headers(spark, sf_dir):
    cells = markdown_cells(F.col("content"))
    heads = F.filter(F.get(cells, F.lit(0)), lambda c: c != "")
    return derived.rows(spark, sf_dir, TABLES).select("id", F.coalesce(F.array_join(heads, ","), F.lit("")).alias("headers"), F.greatest(F.lit(0), F.size(cells) - 1).alias("n_rows"))


@BOOK.add("""SELECT item_id, CAST(len(list_filter(['benchmark','the','and','en'], lambda t: contains(lower(text), t))) AS BIGINT) AS overlap FROM benchmark""")
def math14_term_overlap(spark, sf_dir):
    """How many distinct terms of a question, of two characters and more, a text holds."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.lit("Benchmark the and, the x en?")), F.lit(r"(?U)[\w一-鿿]{2,}"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(F.filter(terms, lambda t: F.contains(F.lower(F.col("text")), t))).cast("long").alias("overlap"))


@BOOK.add("SELECT o_orderkey, greatest(0, least(100, o_orderkey % 150 - 20)) AS progress FROM orders")
def math8_clamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.clamp(F.col("o_orderkey") % 150 - 20, 0, 100).cast("long").alias("progress"))


@BOOK.add("""SELECT p_partkey AS id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE format('{:.6g}', v) END AS shown FROM (SELECT p_partkey, p_retailprice * p_size / 3 AS v FROM part)""")
def math15_number_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), numbers.number_text(F.col("p_retailprice") * F.col("p_size") / 3).alias("shown"))


@BOOK.add("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, ts >= TIMESTAMP '2024-01-08' - INTERVAL 7 DAY AS recent FROM events""")
def dt1_clock(spark, sf_dir):
    """Times at the fixed offset of eight hours (DT-1), shown in both forms (DT-7), and a window of seven days (DT-2)."""
    now = F.lit("2024-01-08").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")).alias("local"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), (F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")).alias("recent"))


@BOOK.add("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) > 259200000000 END AS stale FROM events""")
def dt4_stale(spark, sf_dir):
    """Stale is what was last touched more than N seconds ago, or never."""
    seconds = F.lit(300 * 864)
    last = F.coalesce(F.lit(None).cast("timestamp"), F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")))
    age = (F.unix_micros(F.lit("2024-01-20").cast("timestamp")) - F.unix_micros(last)) / 1e6
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(age > seconds, F.lit(True)).alias("stale"))


@BOOK.add("""SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events""")
def hsh4_random_ids(spark, sf_dir):
    """Each row gets an id of its own."""
    return table(spark, sf_dir, "events").select(F.uuid().alias("id")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@BOOK.add("""SELECT lower(text) AS claim, source_type, source_id, min(k) AS first FROM (SELECT text, role AS source_type, conv_id % 7 AS source_id, conv_id * 1000 + turn AS k FROM conversations) GROUP BY ALL""")
def set8_claim_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.lower("text").alias("claim"), F.col("role").alias("source_type"), (F.col("conv_id") % 7).alias("source_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    return rows.groupBy("claim", "source_type", "source_id").agg(F.min("k").alias("first"))


@BOOK.add(f"""WITH {cte('i', ITEMS)}, l AS (SELECT job_id, figure_label, max(id) AS id FROM i WHERE figure_label IS NOT NULL GROUP BY job_id, figure_label) SELECT l.job_id, l.figure_label, i.value_text, i.image_type FROM l JOIN i ON l.id = i.id""")
def win14_latest_per_figure(spark, sf_dir):
    rows = derived.rows(spark, sf_dir, ITEMS).where("figure_label is not null").groupBy("job_id", "figure_label").agg(F.max_by(F.struct("value_text", "image_type"), "id").alias("v"))
    return rows.select("job_id", "figure_label", "v.*")


@BOOK.add("""SELECT doc_id, 'p' || (doc_id % 3) AS note, CAST(CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END AS INTEGER) AS pieces, CAST(CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 807 ELSE 900 END AS INTEGER) AS longest FROM documents""")
def str27_note_pieces(spark, sf_dir):
    body = F.when(F.col("doc_id") % 3 == 0, " \n\n ").when(F.col("doc_id") % 3 == 1, F.concat(F.repeat(F.lit("a"), 400), F.lit("\n\nb\n \n"), F.repeat(F.lit("c"), 402))).otherwise(F.concat(F.lit("short\n\n"), F.repeat(F.lit("x"), 2000), F.lit("\n\n"), F.repeat(F.lit("y"), 600)))
    pieces = note_pieces(body)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("note"), pieces.alias("p")).select("doc_id", "note", F.size("p").alias("pieces"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


@BOOK.add("""WITH p AS (SELECT conv_id AS doc_id, turn AS page, 'Journal of Tests ' || turn AS head, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT DISTINCT doc_id, head AS line FROM p WHERE n >= 2 UNION SELECT doc_id, 'Foot' FROM p WHERE n >= 2""")
def win11_repeated_edges(spark, sf_dir):
    """Running heads and feet of documents of two pages and more."""
    page = F.concat(F.lit("Journal of Tests "), F.col("turn").cast("string"), F.lit("\nrow "), F.md5(F.concat_ws("/", "conv_id", "turn")), F.lit("\nbody of it\nand "), F.md5(F.concat_ws(":", "turn", "conv_id")), F.lit("\nFoot"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), page.alias("text"))
    return documents.repeated_edges(rows)


@BOOK.add("""SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS recent FROM events""")
def dt2_recent(spark, sf_dir):
    """Within the seven days before the last event."""
    events = table(spark, sf_dir, "events")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    return rows.select("event_id", (F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("recent"))


@BOOK.add("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown FROM orders""")
def dt7_output(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@BOOK.add("""SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS head FROM documents""")
def arr9_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("head"))


@BOOK.add("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"seen":true}' AS metadata FROM events""")
def dml10_metadata_update(spark, sf_dir):
    """A key added to the metadata of every row; what was there stays as it was."""
    return table(spark, sf_dir, "events").select("event_id", merged(F.col("props"), F.lit('{"seen": true}')).alias("metadata"))
