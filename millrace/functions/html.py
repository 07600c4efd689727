"""Tables of web pages, as Spark expressions: a page is cut into tags and texts, and depth is folded over its table tags.

Comments, scripts and styles are no text and hold no tags; tags may have ``>`` inside quoted values; end tags of rows and cells may be
missing.  A table inside a cell belongs to that cell's table only as a whole: its rows, texts and links are left out.  Header rows
(in ``thead``, or of ``th`` cells alone) are marked.  A page without such a table, an empty page and a null page have no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, scripts and styles as a whole; tags; texts; a < that begins no tag.  Nothing here backtracks.
_PARTS = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*+>|\z)|</?+[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<![^>]*+>|[^<]++|<"""
_NAME = r"^</?+([a-zA-Z][a-zA-Z0-9]*+)"
_APART = ("br", "p", "div", "li", "hr")
# Named characters of HTML.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bdquo": "„", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·",
    "copy": "©", "reg": "®", "trade": "™", "sect": "§", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ",
}
# End of fixed values.


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def decoded(text: Column) -> Column:
    """Named and numeric character references as characters; unknown names stay as written, numbers of no character become U+FFFD."""
    names = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (f"&{k};", v)])
    pieces = F.regexp_extract_all(text, F.lit(r"&#[0-9]{1,8};|&#[xX][0-9a-fA-F]{1,7};|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"), F.lit(0))

    def one(piece: Column) -> Column:
        code = F.when(piece.rlike("^&#[xX]"), F.conv(F.regexp_extract(piece, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("int")).otherwise(F.regexp_extract(piece, "([0-9]+)", 1).cast("int"))
        valid = lambda c: (c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        character = _let(code, lambda c: F.decode(F.unhex(F.lpad(F.hex(F.when(valid(c), c).otherwise(0xFFFD)), 8, "0")), "UTF-32"))
        return F.when(piece.startswith("&#") & (F.length(piece) > 3), character).otherwise(F.coalesce(names[piece], piece))

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def parts(html: Column) -> Column:
    """The page in order as structs (at, name, close, raw): ``name`` is a tag's in small letters, and empty for text; no comments, scripts or styles."""
    raw = F.filter(F.regexp_extract_all(html, F.lit(_PARTS), F.lit(0)), lambda r: ~r.rlike(r"(?is)^<(?:!|script\b|style\b)"))
    name = lambda r: F.lower(F.regexp_extract(r, _NAME, 1))
    return F.transform(raw, lambda r, i: F.struct(i.alias("at"), name(r).alias("name"), (r.startswith("</") & (name(r) != "")).alias("close"), r.alias("raw")))


def _of_class(raw: Column, css_class: str | None) -> Column:
    if css_class is None:
        return F.lit(True)
    value = F.regexp_extract(raw, r"""(?is)[\s"']class\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.array_contains(F.split(F.regexp_replace(value, "[\"']", ""), r"\s+"), css_class)


def _first_table(page: Column, css_class: str | None) -> Column:
    """The parts inside the page's first table of a class, without those of the tables inside it."""
    none = F.lit(-1)
    nothing = F.array().cast("array<struct<first: int, last: int>>")
    start = F.struct(none.alias("first"), none.alias("last"), F.lit(0).alias("depth"), none.alias("inner"), nothing.alias("inside"))

    def step(s: Column, t: Column) -> Column:
        def to(first=s["first"], last=s["last"], depth=s["depth"], inner=s["inner"], inside=s["inside"]) -> Column:
            return F.struct(first.alias("first"), last.alias("last"), depth.alias("depth"), inner.alias("inner"), inside.alias("inside"))

        opened = F.when(s["depth"] == 1, to(depth=s["depth"] + 1, inner=t["at"])).otherwise(to(depth=s["depth"] + 1))
        left = F.array_append(s["inside"], F.struct(s["inner"].alias("first"), t["at"].alias("last")))
        closed = F.when(s["depth"] == 1, to(last=t["at"], depth=F.lit(0))).when(s["depth"] == 2, to(depth=F.lit(1), inside=left)).otherwise(to(depth=s["depth"] - 1))
        looking = F.when(~t["close"] & _of_class(t["raw"], css_class), to(first=t["at"], depth=F.lit(1))).otherwise(s)
        return F.when(s["last"] >= 0, s).when(s["first"] < 0, looking).when(t["close"], closed).otherwise(opened)

    found = F.aggregate(F.filter(page, lambda t: t["name"] == "table"), start, step)
    end = F.size(page)

    def own(s: Column) -> Column:
        # tables that aren't closed end with the page
        last = F.when(s["last"] >= 0, s["last"]).otherwise(end)
        inside = lambda t: F.exists(s["inside"], lambda r: t["at"].between(r["first"], r["last"])) | ((s["depth"] > 1) & (t["at"] >= s["inner"]))
        return F.when(s["first"] >= 0, F.filter(page, lambda t: (t["at"] > s["first"]) & (t["at"] < last) & ~inside(t)))

    return _let(found, own)


def _upto(tokens: Column, ends: Callable[[Column], Column]) -> Column:
    """The parts before the first for which ``ends`` holds."""
    return _let(F.array_position(F.transform(tokens, ends), True), lambda at: F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int") - 1)).otherwise(tokens))


def _pieces(tokens: Column, names: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    """(tag, inside) of each start tag of the names: what follows it up to the next of them, or an end tag of ``ends``."""
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t["name"].isin(*names) & ~t["close"], i)), lambda i: i.isNotNull())

    def piece(at: Column, k: Column, all_: Column) -> Column:
        to = F.coalesce(F.get(all_, k + 1), F.size(tokens))
        inside = F.slice(tokens, at + 2, to - at - 1)
        return F.struct(F.get(tokens, at).alias("tag"), _upto(inside, lambda t: t["close"] & t["name"].isin(*ends)).alias("inside"))

    return _let(places, lambda all_: F.transform(all_, lambda at, k: piece(at, k, all_)))


def _text(tokens: Column) -> Column:
    joined = F.array_join(F.transform(tokens, lambda t: F.when(t["name"] == "", t["raw"]).when(t["name"].isin(*_APART), F.lit(" ")).otherwise("")), "")
    return F.trim(F.regexp_replace(decoded(joined), r"[\s\x{00A0}]+", " "))


def _link(tokens: Column) -> Column:
    """The text of the first link among the parts; null without one."""
    return _let(F.get(_pieces(tokens, ("a",), ("a",)), 0), lambda p: F.when(p.isNotNull(), _text(p["inside"])))


def table_rows(html: Column, css_class: str | None = None) -> Column:
    """The rows of the page's first table (of a class, if given): structs (header, link, cells), of cells (header, text, link).

    A row's ``link`` is the text of its first link.
    """

    def cell(c: Column) -> Column:
        return F.struct((c["tag"]["name"] == "th").alias("header"), _text(c["inside"]).alias("text"), _link(c["inside"]).alias("link"))

    def row(r: Column, heads: Column) -> Column:
        def of(cells: Column) -> Column:
            header = ((F.size(cells) > 0) & F.forall(cells, lambda c: c["header"])) | F.exists(heads, lambda h: r["tag"]["at"].between(h["first"], h["last"]))
            return F.struct(header.alias("header"), _link(r["inside"]).alias("link"), cells.alias("cells"))

        return _let(F.transform(_pieces(r["inside"], ("td", "th"), ("td", "th")), cell), of)

    def rows(own: Column) -> Column:
        ends = lambda p: F.struct(p["tag"]["at"].alias("first"), F.coalesce(F.element_at(p["inside"], -1)["at"], p["tag"]["at"]).alias("last"))
        head = lambda p: F.struct(p["tag"].alias("tag"), _upto(p["inside"], lambda t: ~t["close"] & t["name"].isin("tbody", "tfoot")).alias("inside"))
        some = lambda p: F.size(p["inside"]) > 0
        heads = F.transform(F.filter(F.transform(_pieces(own, ("thead",), ("thead",)), head), some), ends)
        return _let(heads, lambda h: F.transform(_pieces(own, ("tr",), ("tr", "thead", "tbody", "tfoot")), lambda r: row(r, h)))

    none = F.array().cast("array<struct<header: boolean, link: string, cells: array<struct<header: boolean, text: string, link: string>>>>")
    return F.coalesce(_let(parts(html), lambda page: _let(_first_table(page, css_class), rows)), none)


def table_links(html: Column, css_class: str | None = None) -> Column:
    """For each row but header rows of the page's first table (of a class, if given), the text of its first link; rows without one are left out."""
    return F.transform(F.filter(table_rows(html, css_class), lambda r: ~r["header"] & (r["link"] != "")), lambda r: r["link"])
