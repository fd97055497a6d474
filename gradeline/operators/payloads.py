"""Bulk vendor payloads (one JSON text per row) to layout blocks or markdown.

A payload is one page or one document, so every step stays inside its row: no shuffle, no Python.
Each ``*_blocks`` returns the input keys with ``idx, id, kind, bbox, confidence, text`` rows.
Rounding is half-to-even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions import geometry as geo
from gradeline.functions.text import strip_space

BOX = "struct<left:double,top:double,right:double,bottom:double>"

# Class names of the annotation sets; an empty class is dropped.
COCO_CLASSES = {
    "Bar/QR Codes": "figure", "Caption": "text", "Code Block": "text", "Footer": "footer",
    "Footnote/Endnote": "text", "Form": "key_value", "Formula": "text",
    "Graphical Item": "figure", "Header": "header", "Heading": "heading",
    "Key Value": "key_value", "Legend": "text", "Line Number": "text", "List Item": "text",
    "Page Number": "page_number", "Picture/Figure/Image/Chart": "figure",
    "Signature / Signature Block": "text", "Subheading": "section_heading", "Table": "table",
    "Table_of_contents": "table", "Text": "text", "Unknown/Other": "", "Watermark": "",
}
# Paragraph roles of the span-based vendor.
AZURE_ROLES = {
    "title": "title", "sectionHeading": "section_header", "pageHeader": "page_header",
    "pageFooter": "page_footer", "pageNumber": "page_number", "footnote": "footnote",
}
AZURE_COVERED = 0.90
# Block types of the block-graph vendor.
TEXTRACT_CLASSES = {
    "LAYOUT_TABLE": "table", "LAYOUT_FIGURE": "figure", "LAYOUT_TITLE": "title",
    "LAYOUT_SECTION_HEADER": "section_header", "LAYOUT_HEADER": "page_header",
    "LAYOUT_FOOTER": "page_footer", "LAYOUT_PAGE_NUMBER": "page_number", "LAYOUT_TEXT": "text",
    "LAYOUT_KEY_VALUE": "key_value", "SIGNATURE": "signature", "TABLE_TITLE": "table_caption",
    "TABLE_FOOTER": "table_footer",
}
# Block types of the run-based vendor.
RUN_CLASSES = {
    "text": "text", "heading": "heading", "section_heading": "section_heading",
    "header": "header", "footer": "footer", "page_number": "page_number", "figure": "figure",
    "barcode": "figure", "table": "table", "table_head": "table", "key_value": "key_value",
    "formula": "text",
}
# Labels of the structure detector.
PADDLE_CLASSES = {
    "text": "text", "doc_title": "heading", "paragraph_title": "section_heading",
    "header": "header", "footer": "footer", "footnote": "text", "caption": "text",
    "page_number": "page_number", "table": "table", "image": "figure", "figure": "figure",
    "chart": "figure", "formula": "text", "seal": "figure", "Text": "text",
    "Heading": "heading", "Subheading": "section_heading", "Header": "header",
    "Footer": "footer", "Caption": "text", "Page Number": "page_number", "Table": "table",
    "Picture": "figure", "Figure": "figure", "Image": "figure", "Chart": "figure",
    "Formula": "text", "List Item": "text", "Form Region": "key_value",
    "Key-Value Pair": "key_value", "Bar/QR Codes": "figure",
}
# Types a prompted model may name.
VLM_CLASSES = {
    "text": "text", "heading": "heading", "title": "heading",
    "section_heading": "section_heading", "section_header": "section_heading",
    "header": "header", "page_header": "header", "footer": "footer", "page_footer": "footer",
    "page_number": "page_number", "figure": "figure", "barcode": "figure", "table": "table",
    "table_head": "table", "key_value": "key_value", "caption": "text",
    "figure_caption": "text", "formula": "text", "list_item": "text", "footnote": "text",
    "signature": "text",
}
# Categories of the array-output model, normalised.
DOTS_CLASSES = {
    "text": "text", "title": "heading", "section_header": "section_heading",
    "section_heading": "section_heading", "subheading": "section_heading",
    "heading": "heading", "table": "table", "picture": "figure", "figure": "figure",
    "image": "figure", "chart": "figure", "caption": "text", "figure_caption": "text",
    "table_caption": "text", "formula": "text", "equation": "text", "list_item": "text",
    "list": "text", "page_footer": "footer", "footer": "footer", "page_header": "header",
    "header": "header", "footnote": "text", "endnote": "text", "page_number": "page_number",
    "key_value": "key_value", "form": "key_value",
}
# Block types of the chunk-based vendor.
REDUCTO_CLASSES = {
    "Title": "heading", "Header": "header", "Footer": "footer",
    "Section Header": "section_heading", "Text": "text", "Table": "table", "Figure": "figure",
    "Key Value": "key_value", "List Item": "text", "Page Number": "page_number",
    "Comment": "text", "Signature": "text",
}
# Labels of the detector behind the vision-language parser.
PADDLE_VL_CLASSES = {
    "text": "text", "title": "heading", "doc_title": "heading",
    "paragraph_title": "section_heading", "section_header": "section_heading",
    "subheading": "section_heading", "header": "header", "footer": "footer",
    "page_number": "page_number", "figure": "figure", "seal": "figure", "table": "table",
    "key_value": "key_value", "form": "key_value", "formula": "text", "equation": "text",
    "reference": "text", "abstract": "text", "figure_caption": "text", "table_caption": "text",
    "list_item": "text",
}


def look_up(names: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.element_at(table, F.coalesce(key, F.lit("")))


def pixel(v: Column) -> Column:
    return F.bround(v, 0).cast("int")


def box_ltrb(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return geo.box(pixel(left), pixel(top), pixel(right - left), pixel(bottom - top))


def rows_of(df: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """One row per entry of an array of block structs, ``idx`` in array order."""
    return df.select(*keys, F.posexplode(blocks).alias("idx", "b")).select(*keys, "idx", "b.*")


def block(kind: Column, bbox: Column, *, id=None, confidence=None, text=None, order=None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.coalesce(none if id is None else id.cast("string"), none.cast("string")).alias("id"),
        geo.fold_type(kind).alias("kind"), bbox.alias("bbox"),
        F.coalesce(none.cast("double") if confidence is None else confidence, F.lit(1.0))
        .alias("confidence"),
        (none.cast("string") if text is None else text).alias("text"),
        (none.cast("int") if order is None else order.cast("int")).alias("reading_order"),
    )


def last_entries(entries: Column, key: str) -> Column:
    """Entries (structs) with keys that differ; of a repeated key the last one stays.

    The array is sorted by key and place once, then each entry is compared with the one after it.
    """
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e[key].alias("k"), i.alias("i"))))
    after = once(placed, lambda own: F.zip_with(own, F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.struct(
        a["k"].alias("k"), a["i"].alias("i"), b["k"].alias("next"))))
    kept = F.filter(after, lambda e: e["k"].isNotNull() & ~e["k"].eqNullSafe(e["next"]))
    return F.transform(kept, lambda e: F.get(entries, e["i"]))


def coco_blocks(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Annotations with their category's class; both envelope spellings.

    Of a repeated category id the last name holds. An annotation without four box values is no
    block.
    """
    ann = "array<struct<id:bigint,category_id:bigint,bbox:array<double>>>"
    p = F.from_json(
        payload,
        f"annotations {ann}, layout_dets {ann}, categories array<struct<id:bigint,name:string>>",
    )
    df = df.withColumn("_p", p)
    some = lambda c: F.nullif(c, F.array().cast(ann))
    marks = F.coalesce(some(F.col("_p.annotations")), F.col("_p.layout_dets"))
    named = F.transform(
        "_p.categories",
        lambda c: F.struct(
            c["id"], F.coalesce(look_up(COCO_CLASSES, c["name"]), c["name"]).alias("kind")
        ),
    )
    df = df.withColumns({"_n": named, "_m": marks})
    df = df.withColumn("_c", F.map_from_entries(last_entries(F.col("_n"), "id")))
    kept = F.filter(
        F.transform(
            "_m",
            lambda a: F.struct(F.element_at("_c", a["category_id"]).alias("k"), a.alias("a")),
        ),
        lambda e: F.coalesce((e["k"] != "") & (F.size(e["a"]["bbox"]) >= 4), F.lit(False)),
    )
    blocks = F.transform(
        kept,
        lambda e: block(e["k"], geo.box(*[e["a"]["bbox"][i] for i in range(4)]), id=e["a"]["id"]),
    )
    return rows_of(df, keys, blocks)


REGION = "array<struct<pageNumber:int,polygon:array<double>>>"
SPANS = "array<struct<offset:bigint,length:bigint>>"
AZURE_SCHEMA = f"""
  tables array<struct<spans:{SPANS}, boundingRegions:{REGION},
    caption:struct<spans:{SPANS}, boundingRegions:{REGION}>,
    footnotes:array<struct<spans:{SPANS}, boundingRegions:{REGION}>>,
    cells:array<struct<boundingRegions:{REGION}, spans:{SPANS}>>>>,
  figures array<struct<spans:{SPANS}, boundingRegions:{REGION},
    caption:struct<spans:{SPANS}, boundingRegions:{REGION}>>>,
  paragraphs array<struct<role:string, content:string, spans:{SPANS}, boundingRegions:{REGION}>>"""


def _regions(kind: Column, node: Column, spans: Column | None, emit: bool, text=None) -> Column:
    """Items of a node's usable regions: page, offset, box, kind, emit, roleless, text."""
    usable = F.filter(
        F.coalesce(node["boundingRegions"], F.array().cast(REGION)),
        lambda r: F.coalesce((F.size(r["polygon"]) >= 4) & (F.size(r["polygon"]) % 2 == 0),
                             F.lit(False)),
    )
    offset = F.lit(None).cast("bigint") if spans is None else F.try_element_at(
        spans, F.lit(1))["offset"]
    return F.transform(
        usable,
        lambda r: F.struct(
            F.coalesce(r["pageNumber"], F.lit(1)).alias("page"), offset.alias("offset"),
            geo.from_polygon(r["polygon"]).alias("bbox"),
            F.coalesce(kind, F.lit("text")).alias("kind"), F.lit(emit).alias("emit"),
            kind.isNull().alias("roleless"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        ),
    )


def azure_blocks(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Tables, figures and paragraphs by span order.

    A paragraph without role is dropped when an earlier region of its page, a kept paragraph or a
    hidden table cell holds it or covers nine tenths of it. That depends on what was kept before,
    so the regions are folded in order inside the row.
    """
    df = df.withColumn("_p", F.from_json(payload, AZURE_SCHEMA))
    null = F.lit(None).cast("string")
    fields = {f.name: f.dataType.simpleString() for f in df.schema["_p"].dataType.fields}

    def over(name: str, fn) -> Column:
        c = F.col(f"_p.{name}")
        return F.flatten(F.transform(F.coalesce(c, F.array().cast(fields[name])), fn))

    empty = F.array()

    def table(t: Column) -> Column:
        notes = F.flatten(
            F.transform(
                F.coalesce(t["footnotes"], empty.cast(
                    f"array<struct<spans:{SPANS},boundingRegions:{REGION}>>")),
                lambda n: _regions(F.lit("table_footer"), n, n["spans"], True),
            )
        )
        cells = F.flatten(
            F.transform(
                F.coalesce(t["cells"], empty.cast(
                    f"array<struct<boundingRegions:{REGION},spans:{SPANS}>>")),
                lambda n: _regions(F.lit("table_cell"), n, None, False),
            )
        )
        return F.concat(
            _regions(F.lit("table"), t, t["spans"], True),
            _regions(F.lit("table_caption"), t["caption"], t["caption"]["spans"], True),
            notes, cells,
        )

    def figure(f: Column) -> Column:
        return F.concat(
            _regions(F.lit("figure"), f, f["spans"], True),
            _regions(F.lit("figure_caption"), f["caption"], f["caption"]["spans"], True),
        )

    def paragraph(p: Column) -> Column:
        kind = F.when(p["role"].isNotNull(), look_up(AZURE_ROLES, p["role"])).otherwise(null)
        return _regions(kind, p, p["spans"], True, p["content"])

    df = df.withColumns(
        {
            "_fixed": F.concat(over("tables", table), over("figures", figure)),
            "_text": over("paragraphs", paragraph),
        }
    )

    def hidden(seen: Column, x: Column) -> Column:
        return F.exists(
            seen,
            lambda s: (s["page"] == x["page"])
            & (
                geo.contains(s["bbox"], x["bbox"])
                | (geo.overlap_ratio(s["bbox"], x["bbox"], "other") >= AZURE_COVERED)
            ),
        )

    kept = F.aggregate(
        "_text", F.col("_fixed"),
        lambda seen, x: F.when(x["roleless"] & hidden(seen, x), seen).otherwise(
            F.concat(seen, F.array(x))
        ),
    )
    shown = F.filter(kept, lambda x: x["emit"])
    spanned = F.transform(
        F.filter(shown, lambda x: x["offset"].isNotNull()),
        lambda x, i: F.struct(x["page"].alias("page"), x["offset"].alias("offset"), i.alias("i"),
                              x.alias("x")),
    )
    loose = F.filter(shown, lambda x: x["offset"].isNull())
    ordered = F.concat(F.transform(F.array_sort(spanned), lambda s: s["x"]), loose)
    return df.select(*keys, F.posexplode(ordered).alias("idx", "b")).select(
        *keys, F.col("b.page").alias("page"), "idx", geo.fold_type(F.col("b.kind")).alias("kind"),
        "b.bbox", "b.text",
    )


TEXTRACT_SCHEMA = """Blocks array<struct<Id:string,BlockType:string,Text:string,RowIndex:int,
  ColumnIndex:int,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,
  Height:double>>,Relationships:array<struct<Type:string,Ids:array<string>>>>>"""
#: What :func:`lines_in_tables` looks at: the parser skips the rest of each block.
TEXTRACT_PLACES = """Blocks array<struct<Id:string,BlockType:string,Geometry:struct<BoundingBox:struct<
  Left:double,Top:double,Width:double,Height:double>>>>"""


def textract_blocks(
    df: DataFrame, payload: str, keys: list[str], width: Column, height: Column
) -> DataFrame:
    """Layout regions scaled from 0..1 to pixels, numbered after filtering."""
    b = F.from_json(payload, TEXTRACT_SCHEMA)["Blocks"]
    kept = F.filter(
        b,
        lambda x: look_up(TEXTRACT_CLASSES, x["BlockType"]).isNotNull()
        & x["Geometry"]["BoundingBox"].isNotNull(),
    )
    side = lambda x, n: F.coalesce(x["Geometry"]["BoundingBox"][n], F.lit(0.0))
    blocks = F.transform(
        kept,
        lambda x, i: block(
            look_up(TEXTRACT_CLASSES, x["BlockType"]),
            geo.box(pixel(side(x, "Left") * width), pixel(side(x, "Top") * height),
                    pixel(side(x, "Width") * width), pixel(side(x, "Height") * height)),
            id=x["Id"], order=i,
        ),
    )
    return rows_of(df, keys, blocks)


def run_blocks(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Chunk blocks with type, details and confidence fallbacks; rows without a page drop.

    Adds page_number, page_width and page_height to each block: the rounded size that the last block
    of its page to state both gives, else 0. A block without a reading order has its place among
    the blocks kept of its page.
    """
    chunk = f"""array<struct<blocks:array<struct<id:string,type:string,content:string,
      confidence:double,score:double,bounding_box:{BOX},
      details:struct<type:string,image_url:string,confidence:double,score:double>,
      metadata:struct<confidence:double,score:double,page_number:int,reading_order:int,
        page:struct<number:int,width:double,height:double>>>>>>"""
    p = F.from_json(payload, f"output struct<chunks:{chunk}>, chunks {chunk}")
    chunks = F.coalesce(p["output"]["chunks"], p["chunks"])
    every = F.flatten(F.transform(chunks, lambda c: c["blocks"]))

    def kind(x: Column) -> Column:
        d = x["details"]
        return (
            F.when(look_up(RUN_CLASSES, x["type"]).isNotNull(),
                   look_up(RUN_CLASSES, x["type"]))
            .when((d["type"] == "figure_details") & (F.coalesce(d["image_url"], F.lit("")) != ""),
                  "figure")
            .when(d["type"] == "table_details", "table")
        )

    page = lambda x: F.when(
        x["metadata"]["page"].isNotNull(), x["metadata"]["page"]["number"]
    ).otherwise(x["metadata"]["page_number"])
    kept = F.filter(
        every,
        lambda x: kind(x).isNotNull() & page(x).isNotNull()
        & (x["bounding_box"]["left"] + x["bounding_box"]["top"] + x["bounding_box"]["right"]
           + x["bounding_box"]["bottom"]).isNotNull(),
    )
    conf = lambda x: F.coalesce(
        x["confidence"], x["score"], x["metadata"]["confidence"], x["metadata"]["score"],
        F.nullif(x["details"]["confidence"], F.lit(0.0)), x["details"]["score"], F.lit(1.0),
    )
    df = df.withColumn("_k", kept)

    def sides(x: Column) -> Column:
        p = x["metadata"]["page"]
        return F.struct(page(x).alias("page"), F.rint(p["width"]).cast("int").alias("w"), F.rint(p["height"]).cast("int").alias("h"))

    # As in the source, a block states its page's size even if it is dropped later for want of a box.
    stated = F.filter(
        F.transform(F.filter(every, lambda x: kind(x).isNotNull() & page(x).isNotNull()), sides),
        lambda x: x["w"].isNotNull() & x["h"].isNotNull(),
    )
    df = df.withColumn("_d", last_entries(stated, "page"))
    side = lambda x, n: F.coalesce(F.get(F.filter("_d", lambda d: d["page"] == page(x)), F.lit(0))[n], F.lit(0))
    # The place of a block in its page: pages are sorted once, and a page begins where its number first stands.
    pages = F.array_sort(F.transform("_k", lambda x, i: F.struct(page(x).alias("p"), i.alias("i"))))
    df = df.withColumn("_s", pages)
    df = df.withColumn("_n", F.transform("_s", lambda x: x["p"]))
    ranks = F.array_sort(F.transform("_s", lambda x, j: F.struct(
        x["i"].alias("i"), (j + 1 - F.array_position(F.col("_n"), x["p"])).cast("int").alias("place"))))
    df = df.withColumn("_r", ranks)
    blocks = F.transform(
        "_k",
        lambda x, i: F.struct(
            page(x).alias("page_number"), side(x, "w").alias("page_width"), side(x, "h").alias("page_height"),
            block(
                kind(x), box_ltrb(*[x["bounding_box"][n] for n in ("left", "top", "right", "bottom")]),
                id=x["id"], confidence=conf(x), text=x["content"],
                order=F.coalesce(x["metadata"]["reading_order"], F.get(F.col("_r"), i)["place"]),
            ).alias("b"),
        ),
    )
    return df.select(*keys, F.posexplode(blocks).alias("idx", "x")).select(
        *keys, "idx", "x.b.*", "x.page_number", "x.page_width", "x.page_height")


def paddle_blocks(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Structure detector output, first page only."""
    p = F.from_json(
        payload,
        """pages array<struct<res:struct<width:double,height:double,
          parsing_res_list:array<struct<block_id:string,block_label:string,
          block_bbox:array<double>,block_content:string,block_text:string,block_order:int>>>>>""",
    )
    raw = F.try_element_at(p["pages"], F.lit(1))["res"]["parsing_res_list"]
    kept = F.filter(
        raw,
        lambda x: look_up(PADDLE_CLASSES, x["block_label"]).isNotNull()
        & (F.coalesce(F.size(x["block_bbox"]), F.lit(0)) >= 4),
    )
    some = lambda c: F.nullif(c, F.lit(""))
    blocks = F.transform(
        kept,
        lambda x, i: block(
            look_up(PADDLE_CLASSES, x["block_label"]),
            box_ltrb(*[x["block_bbox"][n] for n in range(4)]),
            id=F.concat(F.lit("block_"), F.coalesce(x["block_id"], i.cast("string"))),
            text=F.coalesce(some(x["block_content"]), some(x["block_text"]), F.lit("")),
            order=x["block_order"],
        ),
    )
    return rows_of(df, keys, blocks)


VLM_BLOCK = f"""struct<id:string,type:string,content:string,bounding_box:{BOX},boundingBox:{BOX},
  metadata:struct<reading_order:int,page:struct<number:int,width:double,height:double>>>"""


def _vlm_rows(df: DataFrame, keys: list[str], every: Column) -> DataFrame:
    at = lambda x: F.coalesce(x["bounding_box"], x["boundingBox"])
    kept = F.filter(
        every,
        lambda x: look_up(VLM_CLASSES, F.lower(x["type"])).isNotNull()
        & (at(x)["left"] + at(x)["top"] + at(x)["right"] + at(x)["bottom"]).isNotNull(),
    )
    df = df.withColumn("_k", kept)
    page = lambda x: F.coalesce(x["metadata"]["page"]["number"], F.lit(1))
    # A block without id is named by the blocks its page already has.
    blocks = F.transform(
        "_k",
        lambda x, i: F.struct(
            page(x).alias("page"),
            block(
                look_up(VLM_CLASSES, F.lower(x["type"])),
                box_ltrb(*[at(x)[n] for n in ("left", "top", "right", "bottom")]),
                id=F.coalesce(
                    F.nullif(x["id"], F.lit("")),
                    F.concat(
                        F.lit("block_"),
                        F.size(F.filter("_k", lambda y, j: (j < i) & (page(y) == page(x))))
                        .cast("string"),
                    ),
                ),
                text=F.coalesce(x["content"], F.lit("")), order=x["metadata"]["reading_order"],
            ).alias("b"),
        ),
    )
    return df.select(*keys, F.posexplode(blocks).alias("idx", "e")).select(
        *keys, "idx", F.col("e.page").alias("page"), "e.b.*"
    )


def vlm_blocks(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Prompted-model chunks; blocks of unknown type or without a box drop."""
    p = F.from_json(payload, f"chunks array<struct<blocks:array<{VLM_BLOCK}>>>")
    return _vlm_rows(df, keys, F.flatten(F.transform(p["chunks"], lambda c: c["blocks"])))


DOTS_ELEMENT = """struct<category:string,type:string,label:string,bbox:array<double>,
  box:array<double>,text:string>"""


def dots_blocks(df: DataFrame, reply: str, keys: list[str]) -> DataFrame:
    """Array-output model: fence cut, array salvaged, category normalised, then as chunks."""
    t = strip_space(F.col(reply))
    t = F.regexp_replace(F.regexp_replace(t, r"^```(json)?", ""), r"```$", "")
    t = strip_space(t)
    whole = F.from_json(t, f"array<{DOTS_ELEMENT}>")
    inside = F.from_json(
        t, f"layout array<{DOTS_ELEMENT}>, blocks array<{DOTS_ELEMENT}>, "
        f"elements array<{DOTS_ELEMENT}>, items array<{DOTS_ELEMENT}>",
    )
    cut = F.from_json(F.regexp_extract(t, r"(?s)\[.*\]", 0), f"array<{DOTS_ELEMENT}>")
    found = (
        F.when(t.startswith("["), F.coalesce(whole, cut)).otherwise(cut)
    )
    # An object under other keys: its first list of objects.
    lists = F.transform(
        F.filter(F.map_values(F.from_json(t, "map<string,string>")), lambda v: v.startswith("[")),
        lambda v: F.from_json(v, f"array<{DOTS_ELEMENT}>"),
    )
    listed = F.get(F.filter(lists, lambda a: F.exists(a, lambda e: e.isNotNull())), F.lit(0))
    found = F.when(t.startswith("{"), F.coalesce(
        inside["layout"], inside["blocks"], inside["elements"], inside["items"], listed, cut
    )).otherwise(found)
    # Empty values fall through to the next spelling.
    at = lambda e: F.when(F.size(e["bbox"]) > 0, e["bbox"]).otherwise(e["box"])
    name = lambda e: F.translate(
        F.lower(F.trim(F.coalesce(
            *[F.nullif(e[c], F.lit("")) for c in ("category", "type", "label")], F.lit("Text")
        ))), "- ", "__"
    )
    numbered = F.transform(found, lambda e, i: F.struct(e.alias("e"), (i + 1).alias("n")))
    kept = F.filter(numbered, lambda x: F.coalesce(F.size(at(x["e"])), F.lit(0)) >= 4)
    blocks = F.transform(
        kept,
        lambda x: block(
            F.coalesce(look_up(DOTS_CLASSES, name(x["e"])), F.lit("text")),
            box_ltrb(*[at(x["e"])[i] for i in range(4)]),
            id=F.concat(F.lit("block_"), F.lpad(x["n"].cast("string"), 3, "0")),
            text=F.coalesce(x["e"]["text"], F.lit("")),
        ),
    )
    return rows_of(df, keys, blocks)


def reducto_blocks(
    df: DataFrame, payload: str, keys: list[str], width: Column, height: Column
) -> DataFrame:
    """Chunk-based vendor: 0..1 boxes, unknown types read as text."""
    p = F.from_json(
        payload,
        """result struct<chunks:array<struct<blocks:array<struct<id:string,type:string,
          content:string,bbox:struct<left:double,top:double,width:double,height:double>>>>>>""",
    )
    per_chunk = F.transform(
        p["result"]["chunks"],
        lambda c: F.transform(
            c["blocks"], lambda b, i: F.struct(b.alias("b"), (i + 1).alias("n"))
        ),
    )
    kept = F.filter(F.flatten(per_chunk), lambda x: x["b"]["bbox"].isNotNull())
    v = lambda x, n: F.coalesce(x["b"]["bbox"][n], F.lit(0.0))
    blocks = F.transform(
        kept,
        lambda x: block(
            F.coalesce(look_up(REDUCTO_CLASSES, F.coalesce(x["b"]["type"], F.lit("Text"))),
                       F.lit("text")),
            geo.box(pixel(v(x, "left") * width), pixel(v(x, "top") * height),
                    pixel(v(x, "width") * width), pixel(v(x, "height") * height)),
            id=F.coalesce(F.nullif(x["b"]["id"], F.lit("")),
                          F.concat(F.lit("block_"), F.lpad(x["n"].cast("string"), 4, "0"))),
            text=F.coalesce(x["b"]["content"], F.lit("")),
        ),
    )
    return rows_of(df, keys, blocks)


def paddle_vl_blocks(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Vision-language parser: left-top-right-bottom boxes, unknown labels dropped."""
    p = F.from_json(
        payload, "blocks array<struct<label:string,bbox:array<double>,content:string>>"
    )
    numbered = F.transform(p["blocks"], lambda e, i: F.struct(e.alias("e"), (i + 1).alias("n")))
    label = lambda x: look_up(
        PADDLE_VL_CLASSES, F.lower(F.coalesce(F.nullif(x["e"]["label"], F.lit("")), F.lit("text")))
    )
    kept = F.filter(
        numbered,
        lambda x: label(x).isNotNull() & (F.coalesce(F.size(x["e"]["bbox"]), F.lit(0)) >= 4),
    )
    blocks = F.transform(
        kept,
        lambda x: block(
            label(x), box_ltrb(*[x["e"]["bbox"][i] for i in range(4)]),
            id=F.concat(F.lit("block_"), F.lpad(x["n"].cast("string"), 3, "0")),
            text=F.coalesce(x["e"]["content"], F.lit("")),
        ),
    )
    return rows_of(df, keys, blocks)


# -- payloads to markdown ----------------------------------------------------------------------

# Page furniture that is skipped, and heading marks.
SKIPPED_LAYOUT = ["LAYOUT_HEADER", "LAYOUT_FOOTER", "LAYOUT_PAGE_NUMBER"]
LAYOUT_HEADINGS = {"LAYOUT_TITLE": "# ", "LAYOUT_SECTION_HEADER": "## "}
TABLE_TOLERANCE = 0.005


def child_ids(b: Column) -> Column:
    kids = F.filter(b["Relationships"], lambda r: r["Type"] == "CHILD")
    return F.coalesce(
        F.flatten(F.transform(kids, lambda r: r["Ids"])), F.array().cast("array<string>")
    )


def _inside(inner: Column, outer: Column) -> Column:
    t = TABLE_TOLERANCE
    return (
        (inner["Left"] >= outer["Left"] - t) & (inner["Top"] >= outer["Top"] - t)
        & (inner["Left"] + inner["Width"] <= outer["Left"] + outer["Width"] + t)
        & (inner["Top"] + inner["Height"] <= outer["Top"] + outer["Height"] + t)
    )


def lines_in_tables(blocks: Column) -> Column:
    """Ids of text lines whose box lies in a table's box."""
    at = lambda b: b["Geometry"]["BoundingBox"]

    def inside(all_: Column, boxes: Column) -> Column:
        lines = F.filter(
            all_,
            lambda b: (b["BlockType"] == "LINE") & F.exists(boxes, lambda t: F.coalesce(_inside(at(b), t), F.lit(False))),
        )
        return F.transform(lines, lambda b: b["Id"])

    def boxes_of(all_: Column) -> Column:
        tables = F.filter(all_, lambda b: (b["BlockType"] == "TABLE") & at(b).isNotNull())
        return F.transform(tables, at)

    # Blocks may be a payload still to be parsed: they and the tables' boxes are worked out once a row, not once a line.
    return once(blocks, lambda all_: once(boxes_of(all_), lambda boxes: inside(all_, boxes)))


def joined(parts: Column, glue: str = "\n\n") -> Column:
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), glue)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grid_table(cells: Column) -> Column:
    """Markdown of ``array<struct<r,c,text>>``, places counted from one; the last cell wins.

    Cells are worked out once, and each place looks only at the cells of its row.
    """

    def line(row: Column, n_cols: Column) -> Column:
        values = F.transform(
            F.sequence(F.lit(1), n_cols),
            lambda c: F.coalesce(F.try_element_at(F.filter(row, lambda x: x["c"] == c), F.lit(-1))["text"], F.lit("")),
        )
        return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

    def grid(own: Column, n_cols: Column) -> Column:
        n_rows = F.array_max(F.transform(own, lambda c: c["r"]))
        rows = F.transform(F.sequence(F.lit(1), n_rows), lambda r: F.filter(own, lambda x: x["r"] == r))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n_cols), "|"), F.lit("|"))
        return once(
            F.transform(rows, lambda row: line(row, n_cols)),
            lambda lines: F.array_join(
                F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n"),
        )

    return once(cells, lambda own: F.when(
        F.size(own) > 0,
        once(F.array_max(F.transform(own, lambda c: c["c"])), lambda n_cols: grid(own, n_cols)),
    ).otherwise(""))


def textract_markdown(df: DataFrame, payload: str, out: str = "markdown") -> DataFrame:
    """Block graph to markdown.

    Ids are resolved through a map inside the row. Lines inside tables are left to the tables;
    furniture is skipped; tables that no layout region holds come last.
    """
    df = df.withColumn("_b", F.from_json(payload, TEXTRACT_SCHEMA)["Blocks"])
    df = df.withColumns(
        {
            "_ids": F.map_from_entries(
                F.transform(last_entries(F.col("_b"), "Id"), lambda b: F.struct(b["Id"], b))
            ),
            "_in": lines_in_tables(F.col("_b")),
        }
    )

    def kids(b: Column, kind: str) -> Column:
        return F.filter(
            F.transform(child_ids(b), lambda i: F.try_element_at(F.col("_ids"), i)),
            lambda k: F.coalesce(k["BlockType"] == kind, F.lit(False)),
        )

    def cell_text(c: Column) -> Column:
        words = F.transform(kids(c, "WORD"), lambda w: w["Text"])
        return F.replace(joined(words, " "), F.lit("|"), F.lit("\\|"))

    def table(t: Column) -> Column:
        return grid_table(
            F.transform(
                kids(t, "CELL"),
                lambda c: F.struct(
                    F.coalesce(c["RowIndex"], F.lit(1)).alias("r"),
                    F.coalesce(c["ColumnIndex"], F.lit(1)).alias("c"),
                    cell_text(c).alias("text"),
                ),
            )
        )

    tables = F.filter("_b", lambda b: b["BlockType"] == "TABLE")
    df = df.withColumn(
        "_md",
        F.map_from_entries(
            F.transform(last_entries(tables, "Id"), lambda t: F.struct(t["Id"], table(t).alias("md")))
        ),
    )
    layouts = F.filter("_b", lambda b: b["BlockType"].startswith("LAYOUT_"))

    def region(b: Column) -> Column:
        mine = F.filter(
            F.transform(child_ids(b), lambda i: F.try_element_at(F.col("_md"), i)),
            lambda m: F.coalesce(m != "", F.lit(False)),
        )
        text = joined(
            F.transform(
                F.filter(kids(b, "LINE"), lambda k: ~F.array_contains(F.col("_in"), k["Id"])),
                lambda k: strip_space(k["Text"]),
            ),
            "\n",
        )
        mark = F.coalesce(look_up(LAYOUT_HEADINGS, b["BlockType"]), F.lit(""))
        headed = once(text, lambda t: F.when(t != "", F.concat(mark, t)).otherwise(""))
        return F.when(b["BlockType"].isin(SKIPPED_LAYOUT), "").otherwise(
            once(mine, lambda m: joined(F.concat(F.array(F.when(F.size(m) > 0, "").otherwise(headed)), m)))
        )

    anchored = F.flatten(F.transform(layouts, child_ids))
    rest = F.transform(
        once(anchored, lambda held: F.filter(tables, lambda t: ~F.array_contains(held, t["Id"]))),
        lambda t: F.element_at(F.col("_md"), t["Id"]),
    )
    bare = F.transform(
        F.filter(
            "_b",
            lambda b: (b["BlockType"] == "LINE") & ~F.array_contains(F.col("_in"), b["Id"]),
        ),
        lambda b: strip_space(b["Text"]),
    )
    body = F.when(F.size(layouts) > 0, F.transform(layouts, region)).otherwise(bare)
    return df.withColumn(out, joined(F.concat(body, rest))).drop("_b", "_ids", "_in", "_md")


def paragraphs_outside_tables(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Paragraphs with some span outside every table cell; one without spans stays."""
    p = F.from_json(payload, AZURE_SCHEMA)
    df = df.withColumns({"_para": p["paragraphs"], "_t": p["tables"]})
    cell_spans = F.flatten(
        F.flatten(F.transform("_t", lambda t: F.transform(t["cells"], lambda c: c["spans"])))
    )
    df = df.withColumn("_s", F.filter(cell_spans, lambda s: s["length"].isNotNull()))
    covered = lambda x: F.exists(
        "_s",
        lambda c: (c["offset"] <= x["offset"])
        & (x["offset"] + x["length"] <= c["offset"] + c["length"]),
    )
    kept = F.filter(
        "_para",
        lambda q: F.coalesce(F.size(q["spans"]) == 0, F.lit(True))
        | ~F.coalesce(F.forall(q["spans"], covered), F.lit(False)),
    )
    return df.select(*keys, F.posexplode(kept).alias("idx", "q")).select(
        *keys, "idx", F.col("q.role").alias("role"), F.col("q.content").alias("content")
    )


def chunk_markdown(payload: Column) -> Column:
    """Block contents of a chunked payload in order, titles and headers as headings."""
    p = F.from_json(
        payload, "chunks array<struct<content:string,blocks:array<struct<type:string,content:string>>>>"
    )
    every = F.flatten(F.transform(p["chunks"], lambda c: c["blocks"]))

    def text(b: Column) -> Column:
        body = F.regexp_replace(F.coalesce(b["content"], F.lit("")), r"(?U)\s+$", "")
        mark = F.when(b["type"] == "Title", "# ").when(
            b["type"].isin("Section Header", "Header"), "## "
        ).otherwise("")
        return F.when(body != "", F.concat(mark, body)).otherwise("")

    return joined(F.transform(every, text))


def run_markdown(payload: Column) -> Column:
    """Chunk contents of a run, else its own markdown, else empty."""
    p = F.from_json(
        payload,
        "output struct<chunks:array<struct<content:string>>,markdown:string>, "
        "chunks array<struct<content:string>>",
    )
    pieces = joined(
        F.transform(F.coalesce(p["output"]["chunks"], p["chunks"]), lambda c: c["content"])
    )
    return F.coalesce(F.nullif(pieces, F.lit("")), p["output"]["markdown"], F.lit(""))
