"""HTML extraction by the maximum-scoring subsequence of a page's tokens.

A page is read as tokens: words and tags. Each has the score log P(token | in the main text) / P(token |
outside), so words score above zero and the tags of menus and frames below; a tag's token has its first
class, so names count by what labelled pages teach. The probabilities come from pages that mark their own
main text by an article element, of which a sample bounded by `sample` pages is counted. One linear scan
finds the contiguous run of tokens with the largest sum.

A run cannot have holes, so elements that never belong to an article are cut out before the scan wherever
they stand: menus, headers, footers, side bars, notices, adverts, forms, reader comments, scripts and styles.
They are known by element and role, and containers (div, section, list, table, span) by a class or id that is
such a name as a whole, with a suffix like -box or -list at most. Headings, paragraphs, quotes, table cells and
text-level elements are never cut by name.

The text of the run: character references are decoded, a block's blanks become single ones, and blocks
are joined by one blank; inline tags join what they divide.

Defined results: a null or empty page, or one without words, gives an empty text; an element that is
never closed loses its tag only, but a script or style that is never closed reaches to the end, as in a
browser; where the quotes of a tag leave it without an end, quotes have no meaning from there on; reading is
linear in the length of a page, whatever it holds;
null ids and repeated rows are pages like others; an empty table gives an empty result; other columns
are ignored. If no page marks an article, the weights of PLAIN are used.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:_-]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
        "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mi", "mn", "mo", "ms", "mtext",
        "mrow", "msup", "msub", "mfrac", "msqrt",
}
_FRAME = {
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "datalist", "svg", "canvas",
        "object", "template", "noscript",
}
#: Only these are cut by a name.
_CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "span", "article", "center", "details", "fieldset"}
_NAMES = re.compile(
    r"(?:(?:site|page|top|left|right|global|user|reader)[-_])?"
    r"(?:ads?|advert(?:s|isement|ising)?|banner|side-?bar|cookies?|consent|gdpr|notice|alert|comments?|respond|replies|disqus\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|promo|promotion"
    r"|sponsor(?:ed)?|share|sharing|social|related|newsletter|subscribe|subscription|pop-?up|modal|overlay|log-?in|sign-?up|disclaimer|toolbar|pagination|pager|widgets?|recommend(?:ed|ations)?|skip-?link|hidden|copyright)"
    r"(?:[-_](?:box|bar|wrap|wrapper|container|block|section|list|area|banner|form|links?|menu|top|bottom|left|right|inner|notice|thread|buttons?|slot|unit|\d+))*"
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}


def _plain() -> dict[str, float]:
    """Scores where there is nothing to learn from: links and list items cost more than paragraphs."""
    blocks = {"p", "br", "h1", "h2", "h3", "h4", "blockquote", "pre", "article", "main", "section", "div"}
    costs = ((-0.1, _INLINE - {"a"}), (-0.2, blocks), (-1.5, {"a", "li", "ul", "ol", "td", "tr"}))
    tags = {f"{end}{t}": cost for end in ("", "/") for cost, names in costs for t in names}
    return {" ": 1.0} | tags | {f"-{t}": -0.2 for t in _FRAME | _CONTAINER}


PLAIN = _plain()


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _frame(name: str, at: dict[str, str]) -> bool:
    """Whether such an element never belongs to an article."""
    if name in _FRAME:
        return True
    if name in ("html", "body", "main") or name in _VOID:
        return False
    if name != "article" and ("hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in _ROLES):
        return True
    names = f"{at.get('class', '')} {'' if name == 'article' else at.get('id', '')}"
    return name in _CONTAINER and any(_NAMES.fullmatch(t) for t in names.lower().split())


def _scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page's texts (t), opening (o) and closing (c) tags, in one pass."""
    at, end, quoted, absent = 0, len(page), True, set()
    text = 0  # where the text begins that has not been returned
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            stop, tag = (close + 3 if close >= 0 else end), None
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            close = page.find(">", lt)
            stop, tag = (close + 1 if close >= 0 else end), None
        elif (tag := _TAG.match(page, lt + 1)) is None:
            at = lt + 1
            continue
        else:
            pos, stop = tag.end(), -1
            while quoted and stop < 0:
                m = _STOP.search(page, pos)
                if m is not None and m[0] == ">":
                    stop = m.end()
                elif m is None or (pos := page.find(m[0], m.end()) + 1) == 0:
                    quoted = False
            if stop < 0:
                close = page.find(">", tag.end())
                stop = close + 1 if close >= 0 else end
        if lt > text:
            yield "t", "", page[text:lt]
        at = text = stop
        if tag is None:
            continue
        name, rest = tag[2].lower(), page[tag.end() : stop].removesuffix(">")
        if tag[1]:
            yield "c", name, ""
        elif name in _RAW and not rest.endswith("/"):
            close = None if name in absent else re.compile(rf"</{name}(?=[\s>/])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if close is not None:
                at = text = close.end()
            elif name in ("script", "style"):
                return
            else:
                absent.add(name)
        else:
            yield "o", name, rest
    if text < end:
        yield "t", "", page[text:]


def tokens(page: str) -> list[tuple[str | None, str]]:
    """(feature, text): a tag's feature, or None and a text between tags; frames are cut out."""
    flat = list(_scan(page))
    # the closing tag of each opening one, by name, innermost first
    close_of: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(flat):
        if kind == "o" and name not in _VOID:
            open_.setdefault(name, []).append(i)
        elif kind == "c" and open_.get(name):
            close_of[open_[name].pop()] = i
    out: list[tuple[str | None, str]] = []
    i = 0
    while i < len(flat):
        kind, name, text = flat[i]
        if kind == "t":
            out.append((None, text))
        elif kind == "c":
            out.append((f"/{name}", ""))
        else:
            attributes = _attributes(text)
            if i in close_of and _frame(name, attributes):
                out.append((f"-{name}", ""))
                i = close_of[i] + 1
                continue
            label = (attributes.get("class") or attributes.get("id") or "").lower().split()[:1]
            out.append((f"{name}.{label[0]}" if label else name, ""))
        i += 1
    return out


def _name(feature: str) -> str:
    return feature.lstrip("/-").partition(".")[0]


def counts(page: str) -> Counter:
    """How often each feature stands inside (1) and outside (0) the page's own article element."""
    got: Counter = Counter()
    toks = tokens(page)
    marks = [i for i, (f, _) in enumerate(toks) if f and _name(f) == "article" and f[0] != "-"]
    if not marks or toks[marks[0]][0].startswith("/"):
        return got
    first, last = marks[0], max((i for i in marks if toks[i][0] == "/article"), default=len(toks))
    for i, (f, text) in enumerate(toks):
        got[f or " ", int(first <= i <= last)] += 1 if f else len(text.split())
    return got


def weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = 512) -> dict[str, float]:
    """Scores of features, counted on about `sample` of the pages that mark their article."""
    marked = pages.where(F.col(html_col).contains("<article")).select(F.col(html_col).alias("html"), F.pmod(
        F.xxhash64(F.col(id_col), F.octet_length(html_col)), F.lit(1 << 30)).alias("h"))
    n = marked.count()
    if not n:
        return {}
    few = marked.where(F.col("h") < F.lit(int((1 << 30) * min(1.0, sample / n)))).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                got.update(counts(page))
        yield pa.RecordBatch.from_pylist([{"feature": f, "inside": k, "n": c} for (f, k), c in got.items()], schema=pa.schema(
            [("feature", pa.string()), ("inside", pa.int32()), ("n", pa.int64())]))

    rows = few.mapInArrow(count, "feature string, inside int, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    total = [sum(r["n"] for r in rows if r["inside"] == k) for k in (0, 1)]
    if not all(total):
        return {}
    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r["feature"], [0, 0])[r["inside"]] += r["n"]
    kinds = len(by) + 1
    score = {f: math.log((v[1] + 0.5) / (total[1] + 0.5 * kinds)) - math.log((v[0] + 0.5) / (total[0] + 0.5 * kinds)) for f,
        v in by.items()}
    score[" "] = max(score.get(" ", 0.0), 0.05)  # a word never counts against a region
    return score


def best_run(values: list[float]) -> tuple[float, int, int]:
    """Sum, begin and end of the contiguous run with the largest sum; of equal ones the first, 0 and nothing if none is above 0."""
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, v in enumerate(values):
        if run <= 0:
            run, begin = 0.0, i
        run += v
        if run > best:
            best, span = run, (begin, i + 1)
    return best, *span


def extract(page: str | None, score: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    toks = tokens(page)
    score, unknown = (score, -0.5) if score else (PLAIN, -3.0)
    word = score[" "]

    def value(f: str | None, text: str) -> float:
        if f is None:
            return word * len(text.split())
        s = score.get(f)
        return score.get(("/" if f[0] == "/" else "-" if f[0] == "-" else "") + _name(f), unknown) if s is None else s

    _, *span = best_run([value(*t) for t in toks])
    parts = []
    for f, text in toks[slice(*span)]:
        if f is None:
            parts.append(entities.unescape(text) if "&" in text else text)
        elif _name(f) not in _INLINE or f[0] == "-":
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract_text(pages: DataFrame, score: dict[str, float], id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(p, score) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()),
                pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run,
        "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, weights(pages))
