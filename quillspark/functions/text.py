"""Text functions as column expressions; all run inside the JVM.

White space and letters are Unicode's here, which Java's regular expressions need (?U) for.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
TOKEN = r"[a-zA-Z][a-zA-Z0-9_./:-]{1,80}"
STOP_TERMS = ["about", "and", "are", "can", "does", "for", "from", "how", "into", "the", "this", "that", "use", "using", "what", "when", "where", "with"]
RANK_MARKERS = ["await ", "=>", ".find(", ".init(", "orderBy", "import ", "export ", "const ", "<", "defineConfig", "defineRecipe", "createSystem"]
CODE_MARKERS = ["await ", "const ", "let ", "import ", "export ", "function ", "return ", "=>", ".find(", ".init(", "mikroorm.init", "orderby", "where:", "populate:", "populatewhere:", "populatehints:", "response_model", "uploadfile", "form(", "file(", "colormodebutton", "usecolormode", "defineconfig", "definerecipe", "defineslotrecipe", "createsystem", "npx "]
CODE_SYMBOLS = ["{", "}", "(", ")", ";", ":", "<", ">"]
LOW_VALUE_LABELS = ["console", "cli", "api", "output", "show output"]
TOC_HEADINGS = ["contents", "on this page", "table of contents"]
LOW_VALUE_WEB_LINE = r"^(?:ask ai|copy page|search(?:\.\.\.)?(?:\s*[⌘/]?\s*k)?|thank you for your feedback!?|was this page helpful\??|yes\s*no)$"
FENCED = r"(?s)```[\w.+-]*[^\n]*\n.*?(?:\n```|$)"
CLOSED_FENCE = r"(?s)```.*?```"
FENCED_BODY = r"(?s)```[\w.+-]*[^\n]*\n(.*?)(?:\n```|$)"
#: Lower-case letters that count as others (long s, final sigma and the like), and these.
VARIANTS, VARIED = "\u017f\u03c2\u03d0\u03d1\u03d5\u03d6\u03f0\u03f1\u03f5\u1e9b\u1fbe", "s\u03c3\u03b2\u03b8\u03c6\u03c0\u03ba\u03c1\u03b5s\u03b9"


def _folding() -> tuple[str, str]:
    """Letters that change when terms are compared and what becomes of them; marks at the end of the first have no partner and go.

    A Latin letter with one mark loses it, one with several keeps them, as do other scripts' letters; the marks are those of
    Latin letters, so that decomposed texts are folded alike.
    """
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    single = {c: p[0] for c, p in parts.items() if c.islower() and len(p) == 2 and p[0].isascii()}
    marks = sorted({m for p in parts.values() if p[0].isascii() for m in p[1:] if unicodedata.combining(m)})
    return "".join(single) + VARIANTS + "".join(marks), "".join(single.values()) + VARIED


ACCENTED, PLAIN = _folding()

LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it (lambdas have no common subexpressions)."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens: a letter and up to 80 of letters, digits and _ . / : -"""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def meaningful(text: Column) -> Column:
    """Distinct tokens that aren't stop terms."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOP_TERMS)))


def terms(text: Column) -> Column:
    """Index terms: runs of letters and digits, lower-case, without accents, composed or not."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line behind the last end."""
    return let(F.split(text, LINE_END), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def compact(text: Column) -> Column:
    """No white space at line ends, at most two blank lines in a row, none at the ends."""
    trimmed = F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return strip(F.regexp_replace(trimmed, r"\n{4,}", "\n\n\n"))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, FENCED, "")


def has_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def cut_sentence(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last sentence end, else space, if that is past the half; ends with a period."""
    return let(text, lambda x: let(F.substring(x, 1, limit), lambda head: _cut(x, head, limit)))


def _cut(text: Column, head: Column, limit: int) -> Column:
    last = lambda part: F.char_length(head) - F.char_length(F.substring_index(head, part, -1)) - len(part)
    at = last(". ")
    at = F.when(F.contains(head, F.lit(". ")) & (at >= limit // 2), at).otherwise(F.when(F.contains(head, F.lit(" ")) & (last(" ") >= limit // 2), last(" ")).otherwise(limit))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head.substr(F.lit(1), at.cast("int")), r"[ .]+$", ""), F.lit(".")))


def may_hit(text: Column, wanted: Column) -> Column:
    """False only if no token of a text is wanted: tokens are ASCII letters in lower case, and parts of the text."""
    return let(F.lower(text), lambda low: F.exists(wanted, lambda w: F.contains(low, w)))


def rank_score(candidate: Column, wanted: Column) -> Column:
    """Hits of wanted terms, one more for a sign of code, 0.55 of that for a heading."""

    def of(plain: Column) -> Column:
        hits = F.when(may_hit(plain, wanted), F.size(F.array_intersect(tokens(plain), wanted))).otherwise(0) + has_any(plain, RANK_MARKERS).cast("int")
        return F.when(plain == "", F.lit(0.0)).otherwise(hits * F.when(plain.startswith("#"), F.lit(0.55)).otherwise(F.lit(1.0)))

    return let(collapse(candidate), of)


def best(candidates: Column, wanted: Column) -> Column:
    """The candidate with the highest score that isn't 0, the first of equals; null without one."""
    scored = F.transform(candidates, lambda c, i: F.struct(rank_score(c, wanted).alias("s"), (-i).alias("k"), c.alias("c")))
    top = F.array_max(F.filter(scored, lambda x: x["s"] > 0))
    return top["c"]


def low_value_line(line: Column) -> Column:
    plain = F.lower(collapse(line))
    return (plain == "") | plain.isin(LOW_VALUE_LABELS) | plain.startswith("![") | plain.startswith("was this page helpful") | line.rlike(r"^[-*]\s+\[[^\]]+\]\([^)]*\)$")


def excerpt(content: Column, wanted: Column) -> Column:
    """The best of a text's blocks and of its matching lines with up to two followers."""

    def of_block(block: Column) -> Column:
        return let(F.filter(F.filter(F.transform(let(block, lines), strip), lambda x: x != ""), lambda x: ~let(x, low_value_line)), of_lines)

    def of_lines(useful: Column) -> Column:
        window = lambda x, i: F.when(may_hit(x, wanted) & F.arrays_overlap(tokens(collapse(x)), wanted), F.array_join(_until_heading(F.slice(useful, i + 1, 3)), "\n"))
        found = F.filter(F.transform(useful, window), lambda x: x.isNotNull())
        return F.when(F.size(useful) > 0, F.concat(found, F.array(F.array_join(useful, "\n")))).otherwise(F.array().cast("array<string>"))

    # A block without a wanted term or a sign of code has nothing that scores; blanks around signs may be line ends in it.
    may_score = lambda b: may_hit(b, wanted) | has_any(b, [m.strip() for m in RANK_MARKERS])
    blocks = F.filter(F.transform(F.filter(F.split(without_fences(content), r"\n{2,}"), may_score), strip), lambda x: x != "")
    return F.coalesce(cut_sentence(collapse(best(F.flatten(F.transform(blocks, of_block)), wanted)), 900), F.lit(""))


def _until_heading(window: Column) -> Column:
    """A line and its followers before the first that is a heading."""
    stop = F.when(F.get(window, F.lit(1)).startswith("#"), 1).when(F.get(window, F.lit(2)).startswith("#"), 2).otherwise(3)
    return F.slice(window, F.lit(1), stop)


def summary(content: Column, wanted: Column) -> Column:
    """The best sentence or heading."""
    return let(without_fences(content), lambda plain: _summary(plain, wanted))


def _summary(plain: Column, wanted: Column) -> Column:
    parts = F.filter(F.transform(F.split(plain, r"(?U)(?<=[.!?])\s+|\n{2,}"), strip), lambda x: x != "")
    heads = F.transform(F.filter(lines(plain), lambda x: strip(x).startswith("#")), lambda x: strip(F.regexp_replace(x, r"^[# ]+|[# ]+$", "")))
    text = strip(F.regexp_replace(collapse(best(F.concat(parts, heads), wanted)), r"^#+", ""))
    return F.coalesce(F.regexp_replace(F.substring(text, 1, 420), r"(?U)\s+$", ""), F.lit(""))


def code_like(text: Column) -> Column:
    return (text.rlike(r"</?[A-Z][A-Za-z0-9.]*[\s>/]") | has_any(F.lower(text), CODE_MARKERS)) & has_any(text, CODE_SYMBOLS)


def code(content: Column, wanted: Column) -> Column:
    """The best fenced block that looks like code; null without one."""
    blocks = F.transform(F.filter(F.regexp_extract_all(content, F.lit(FENCED_BODY), F.lit(1)), code_like), strip)
    return F.regexp_replace(F.substring(best(blocks, wanted), 1, 1400), r"(?U)\s+$", "")


def markdown_line(line: Column) -> Column:
    """A line without images, links and heading marks, collapsed, in lower case."""
    text = F.regexp_replace(F.regexp_replace(line, r"!\[[^\]]*\]\([^)]+\)", ""), r"\[[^\]]*\]\([^)]*\)", "")
    return F.lower(collapse(F.regexp_replace(text, r"(?U)^\s{0,3}#{1,6}\s+", "")))


def low_value_web_line(plain: Column) -> Column:
    return plain.rlike(f"(?iU){LOW_VALUE_WEB_LINE}")


def web_chrome(text: Column) -> Column:
    """Whether two lines at least are page furniture."""
    odd = F.filter(F.transform(lines(text), markdown_line), lambda x: x.isin(TOC_HEADINGS) | low_value_web_line(x))
    return F.size(odd) >= 2


#: A fixed value that results depend on: words that an extraction has at least.
SUBSTANTIAL_WORDS = 25
_MARKDOWN_LINK = r"\[([^\]]*)\]\([^)]*\)"


def substantial(text: Column) -> Column:
    """Whether a text has words enough to be a page's content; false for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+")) >= SUBSTANTIAL_WORDS, F.lit(False))


def without_link_blocks(text: Column) -> Column:
    """Markdown without the blocks, headings apart, of whose characters more than half are the words of links: menus and the like."""
    words = lambda b: F.char_length(F.array_join(F.regexp_extract_all(b, F.lit(_MARKDOWN_LINK), F.lit(1)), ""))
    plain = lambda b: F.char_length(F.regexp_replace(b, _MARKDOWN_LINK, "$1"))
    return F.array_join(F.filter(F.split(text, "\n{2,}"), lambda b: b.startswith("#") | (words(b) * 2 <= plain(b))), "\n\n")


def clean_web(text: Column) -> Column:
    """Web text without images, furniture lines and tables of contents (their blanks and bullets, up to a heading).

    Each line is looked at once and gets a letter; letters in a row, in place of a fold, tell what a table of contents takes.
    """
    entry = lambda line: (strip(line) == "") | line.rlike(r"(?U)^\s*[-*]\s+")

    def letter(line: Column, plain: Column) -> Column:
        head = F.when(low_value_web_line(plain), F.when(line.startswith("#"), "D").otherwise("L")).when(line.startswith("#"), "H")
        return F.when(plain.isin(TOC_HEADINGS), "T").otherwise(head.when(entry(line), "B").otherwise("O"))

    bare = F.transform(lines(text), lambda raw: F.regexp_replace(F.regexp_replace(raw, r"!\[[^\]]*\]\([^)]+\)", ""), r"(?U)\s+$", ""))
    # Behind a table's heading (T) entries (B) go up to the next heading (H, or D, which goes itself) or table.
    coded = lambda seen: F.split(F.regexp_replace(F.array_join(F.transform(seen, lambda x: x["kind"]), ""), r"(T[^HDTB]*|\G(?!\A)[^HDTB]*)B", "$1X"), "")
    known = F.transform(bare, lambda line: F.struct(line.alias("line"), let(markdown_line(line), lambda plain: letter(line, plain)).alias("kind")))
    left = let(known, lambda seen: let(coded(seen), lambda k: F.filter(seen, lambda x, i: F.get(k, i).isin("H", "B", "O"))))
    return compact(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?sU)\A---\s*\n.*?\n---\s*(?:\n|\z)", ""), r"(?U)\A\s+", "")


def strip_tags(html: Column) -> Column:
    """Scripts, styles and tags as spaces, the five common references decoded; not compacted."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"(?is)<(?:!doctype\s+html|html|body|main|article|section|h[1-6]|p|pre|code|ul|ol|li|a)\b")


def title(text: Column) -> Column:
    """The first level-one heading of the first 40 lines; null without one."""
    heads = F.filter(F.slice(lines(text), 1, 40), lambda x: strip(x).rlike(r"(?U)^#\s+.+$"))
    return strip(F.regexp_replace(strip(F.get(heads, F.lit(0))), r"(?U)^#\s+", ""))


def capitalised(text: Column) -> Column:
    """- and _ as spaces, words in title case (a capital after anything but a letter)."""
    plain = F.translate(text, "-_", "  ")
    parts = F.regexp_extract_all(plain, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**31 - 1)))), "")


def web_title(url: Column) -> Column:
    """The last segment of a URL's path, or its host, as a title."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/+|/+$", "")
    return capitalised(F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def root_domain(url: Column) -> Column:
    host = F.split(F.try_parse_url(url, F.lit("HOST")), r"\.")
    return F.array_join(F.slice(host, F.greatest(F.lit(1), F.size(host) - 1), F.lit(2)), ".")


def content_type(uri: Column) -> Column:
    path = F.coalesce(F.nullif(F.try_parse_url(uri, F.lit("PATH")), F.lit("")), uri)
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    kind = F.lit(None)
    for names, value in (((".md", ".mdx"), "markdown"), ((".html", ".htm"), "html"), ((".json",), "json"), ((".yaml", ".yml"), "yaml"), ((".toml",), "toml"), ((".rst",), "rst"), ((".txt",), "text")):
        kind = F.when(suffix.isin(*names), value).otherwise(kind)
    return F.coalesce(kind, F.when(uri.rlike(r"(?i)^https?:"), "web"), F.lit("text"))


def has_table(text: Column) -> Column:
    """Whether a line with a pipe precedes a separator row."""
    rows = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    return F.exists(F.transform(rows, lambda x, i: F.contains(x, F.lit("|")) & F.coalesce(F.get(rows, i + 1).rlike(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"), F.lit(False))), lambda x: x)


def chunk_kind(text: Column) -> Column:
    fenced = text.rlike(CLOSED_FENCE)
    return F.when(has_table(text), "table").when(fenced & (F.size(tokens(F.regexp_replace(text, CLOSED_FENCE, ""))) >= 5), "mixed").when(fenced, "code").otherwise("text")


def parent_key(uri: Column, path: Column, content: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\n", uri, path, content)), 1, 16)
