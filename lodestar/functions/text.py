"""Text operators as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no weight in lexical search. Single letters are never dropped.
STOPWORDS = """
the be to of and in that have it for not on with he as you do at this but his by
from they we say her she or an will my one all would there their what so up out
if about who get which go me when make can like time no just him know take people
into year your good some could them see other than then now look only come its
over think also back after use two how our work first well way even new want
because any these give day most us is are was were been has had does did doing
""".split()

# Tokens that end a fragment without ending a sentence.
ABBREVIATIONS = """
e.g. i.e. vs. cf. al. approx. ca. resp. etc.
Fig. Figs. Tab. No. Nos. Dr. Prof. Inc. Ltd.
St. Jr. Sr. p. pp. vol. ed. eds. min. max.
""".split()

# Patterns that other systems' texts are held against.
TOKEN_PATTERN = r"[a-z0-9]+(?:[-'/][a-z0-9]+)*"
COMPOUND_SPLIT = r"[-'/]"
ABSTENTION_PATTERN = r"(?i)INSUFFICIENT[\s_-]*CONTEXT"
DEGENERATE_PATTERN = r"(.)\1{11,}"
CITATION_PATTERN = r"\[([^\]]+?)\]"
ABSTENTION_SENTINEL = "INSUFFICIENT_CONTEXT"

#: Marks a sentence end while fragments are being merged; it does not occur in prose.
_MARK = "\u0001"


def tokens(text: Column, use_stopwords: bool = True) -> Column:
    """Lower-case alphanumeric terms; a compound is followed by its parts.

    ``mg/dl`` gives ``mg/dl, mg, dl``.  A stopword is dropped as a whole term and as a part.
    """
    low = F.lower(text)
    terms = F.regexp_extract_all(low, F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    wanted = (lambda t: ~t.isin(STOPWORDS)) if use_stopwords else (lambda t: F.lit(True))
    kept = F.filter(terms, wanted) if use_stopwords else terms
    joined = lambda t: t.contains("-") | t.contains("'") | t.contains("/")
    parts = lambda t: F.filter(F.split(t, COMPOUND_SPLIT), lambda p: (p != "") & (p != t) & wanted(p))
    expanded = F.flatten(F.transform(kept, lambda t: F.when(joined(t), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))
    return F.when(low.rlike("[a-z0-9][-'/][a-z0-9]"), expanded).otherwise(kept)  # most texts have no compound


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def containment(part: Column, whole: Column) -> Column:
    """Share of the distinct tokens of ``part`` that ``whole`` has; null if ``part`` is empty."""
    return F.try_divide(F.size(F.array_intersect(part, whole)), F.size(F.array_distinct(part)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of spaces and tabs to one space, three or more line feeds to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def flatten_markup(xml: Column) -> Column:
    """Text of an inline-markup fragment with white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(xml, r"<[^>]+>", ""), r"(?U)\s+", " "))


def unescape_entities(text: Column) -> Column:
    """Entities by name or by number; each is read once, unknown ones stay.

    Without a semicolon a name must be one of those that HTML allows so, and end where the word ends.
    """
    names = F.create_map(*[F.lit(x) for n, c in sorted({**name2codepoint, "apos": 39}.items()) for x in (n, chr(c))])
    bare = [n for n in html5 if not n.endswith(";")]
    hexed = lambda number: F.lpad(F.hex(number), 8, "0")

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*)(;|$|[^A-Za-z0-9])", 1)
        closed = F.substring(piece, F.length(name) + 1, F.lit(1)) == ";"
        digits = F.when(F.substring(name, 2, 1).isin("x", "X"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("long")
        valid = digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        number = F.when(valid, F.decode(F.unhex(hexed(F.coalesce(F.when(valid, digits), F.lit(32)))), "UTF-32")).otherwise("\ufffd")
        char = F.when((name == "") | ~closed & ~name.isin(bare), F.lit(None).cast("string")).when(F.substring(name, 1, 1) == "#", number).otherwise(F.try_element_at(names, name))
        return F.when(char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, F.substring(piece, F.length(name) + F.when(closed, 2).otherwise(1), F.length(piece))))

    whole = F.array_join(F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(read(p))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def markdown_sections(text: Column) -> Column:
    """array<struct<heading, text>>: split at lines ``#`` to ``####``; empty bodies are dropped.

    Without any heading the whole text is one section, be it empty or not.
    """
    pattern = r"(?m)^#{1,4}\s+(.+?)\s*$"
    marked = F.regexp_replace(text, pattern, f"{_MARK}$1{_MARK}")
    pieces = F.split(marked, _MARK)
    n = ((F.size(pieces) - 1) / 2).cast("int")
    section = lambda heading, body: F.struct(heading.cast("string").alias("heading"), body.alias("text"))
    first = F.array(section(F.lit(None), squeeze(F.element_at(pieces, 1))))
    rest = F.when(
        n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: section(strip(F.element_at(pieces, 2 * i)), squeeze(F.element_at(pieces, 2 * i + 1))))
    ).otherwise(F.array().cast("array<struct<heading:string,text:string>>"))
    return F.when(n == 0, first).otherwise(F.filter(F.concat(first, rest), lambda s: s["text"] != ""))


def html_to_text(html: Column) -> Column:
    """Scripts and styles out, h1-h4 to markdown headings, tags to spaces, entities decoded.

    Tags inside a heading vanish without a space.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>", f"\n\n## {_MARK}$1{_MARK}\n\n")
    pieces = F.transform(F.split(body, _MARK), lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"<[^>]+>", "")).otherwise(F.regexp_replace(p, r"<[^>]+>", " ")))
    return squeeze(unescape_entities(F.array_join(pieces, "")))


def html_sections(html: Column) -> Column:
    return markdown_sections(html_to_text(html))


def sentences(text: Column) -> Column:
    """Sentences: split after ``.!?`` and white space, then fragments that end in an
    abbreviation, an initial or an enumerator are joined with what follows."""
    escaped = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    continues = rf"(?U)(^|\s)({escaped}|[A-Z]\.|\(?\d+[.)])$"
    raw = F.filter(F.transform(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), strip), lambda p: p != "")
    marked = F.array_join(F.transform(raw, lambda p: F.concat(p, F.when(p.rlike(continues), F.lit(" ")).otherwise(F.lit(_MARK)))), "")
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda p: p != "")


def leading_year(year: Column, medline_date: Column) -> Column:
    """The year field, else the digits that lead a free-text date such as ``2023 Jan-Feb``."""
    return F.coalesce(F.nullif(strip(year), F.lit("")), F.nullif(F.regexp_extract(medline_date, r"^\s*(\d+)(?=-|\s|$)", 1), F.lit("")))


def is_abstention(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(ABSTENTION_PATTERN)


def is_degenerate(text: Column) -> Column:
    """A character repeated twelve times or more."""
    return F.coalesce(text, F.lit("")).rlike(DEGENERATE_PATTERN)


def citations(answer: Column, valid: Column) -> Column:
    """Bracketed tags of the answer that are valid, once each, in order of first use."""
    tags = F.transform(F.regexp_extract_all(answer, F.lit(CITATION_PATTERN), F.lit(1)), strip)
    return F.array_distinct(F.filter(tags, lambda t: F.array_contains(valid, t)))


def json_text(response: Column) -> Column:
    """The JSON in a model response: fenced block, whole text, outermost braces, brackets.

    The first candidate that parses, as text; null if none does.
    """
    text = strip(response)
    span = lambda o, c: F.nullif(F.regexp_extract(text, rf"(?s)(\{o}.*\{c})", 1), F.lit(""))
    fenced = F.nullif(strip(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.lit(""))
    found = F.lit(None).cast("string")
    for candidate in reversed([fenced, F.nullif(text, F.lit("")), span("{", "}"), span("[", "]")]):
        found = F.when(F.try_parse_json(candidate).isNotNull(), candidate).otherwise(found)
    return found


def citation_tag(doc_id: Column, source_type: Column, section: Column) -> Column:
    """``PMID:<id> §Section`` for literature, ``<doc_id> §Section`` otherwise."""
    base = F.when(source_type == "pubmed", F.concat(F.lit("PMID:"), F.regexp_replace(doc_id, "^pmid:", ""))).otherwise(doc_id)
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(base, F.lit(" §"), section)).otherwise(base)


def render_chunk(tag: Column, title: Column, date: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), tag, F.lit("] "), title, F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(F.lit("")))
    return F.concat(head, F.lit("\n"), text)


def document_text(sections: Column) -> Column:
    """Sections joined by a blank line, each with its heading line where there is one."""
    part = lambda s: F.coalesce(F.concat(F.nullif(s["heading"], F.lit("")), F.lit("\n"), s["text"]), s["text"])
    return F.array_join(F.transform(sections, part), "\n\n")


def chunk_id(doc_id: Column, ordinal: Column, text: Column) -> Column:
    """Content-addressed: 16 hex digits over document, ordinal and text."""
    return F.substring(F.sha1(F.concat(doc_id, F.lit("::"), ordinal.cast("string"), F.lit("::"), text)), 1, 16)


def count_chars4(text: Column) -> Column:
    """Token estimate without a model: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def truncate_tokens(text: Column, max_tokens: int) -> Column:
    """At most ``max_tokens`` estimated tokens, cut back to the last sentence or line end if that
    keeps more than 60 %."""
    cut = F.substring(text, 1, max_tokens * 4)
    back = F.regexp_extract(cut, r"(?s)^(.*)(?:\. |\n)", 1)
    keep = F.length(back) > 0.6 * F.length(cut)
    whole = F.when(F.substring(cut, F.length(back) + 1, F.lit(1)) == ".", F.concat(back, F.lit("."))).otherwise(back)
    return F.when(F.length(text) <= max_tokens * 4, text).when(keep, strip(whole)).otherwise(strip(cut))
