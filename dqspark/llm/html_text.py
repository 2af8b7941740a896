"""Main text of web pages by consensus container paths per host."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th "
                   "thead tr ul".split())
CONTAINERS = frozenset("article body div main section table tbody td tr center".split())
#: Elements that hold no article text.
DROPPED = frozenset("aside button canvas dialog datalist footer form head header iframe menu nav noscript object optgroup option "
                    "script select style svg template textarea title".split())
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment "
                  "comments contentinfo cookie cookies disqus gdpr masthead navbar overlay pager pagination popup "
                  "promo sidebar signup sponsor sponsored toolbar tooltip".split())
#: Words that mark it too, but also name what articles are about; what is so
#: marked inside an article or main element is judged by the host's pages.
WEAK_MARKS = frozenset("alert banner consent footer header login menu modal nav navigation newsletter notice notices "
                       "notification promoted promotion recommended related replies reply respond share sharing social "
                       "subscribe subscription teaser widget".split())
#: Characters from which a block of text reads like a paragraph of an article.
PARAGRAPH = 80
#: A start tag of these ends an open one of the same list, up to the nearest listed bound.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select", "datalist"})}
_P_BOUND = CONTAINERS | {"li", "td", "th", "blockquote", "aside", "header", "footer", "nav", "form", "figure", "dd"}


class _Blocks(HTMLParser):
    """Splits a page into text blocks: ``blocks`` holds (container path,
    dropped by tag, dropped by mark, weak mark, heading, text, characters in
    links).  A weak mark is an element's tag with its weak words."""

    OUTSIDE = ("", None, False, False, None, False, False, False)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # tag, path step or None, by tag, by mark, weak mark, in article, in heading, in link
        self.blocks: list[tuple] = []
        self.parts: list[str] = []
        self.linked = 0

    def parse_html_declaration(self, i):
        """A marked section of an unknown name is a comment up to the next
        bracket, as browsers have it."""
        if self.rawdata.startswith("<![", i) and not self.rawdata.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def unknown_decl(self, data):
        """Other declarations are no text either."""

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            steps = tuple(o[1] for o in self.open if o[1])
            top = self.open[-1] if self.open else self.OUTSIDE
            self.blocks.append((steps, top[2], top[3], top[4], top[6], text, self.linked))
        self.parts, self.linked = [], 0

    def pop_to(self, i):
        self.flush()
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            if tag in CLOSES:
                self.close_open(*CLOSES[tag])
            self.close_open({"p"}, _P_BOUND)
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        top = self.open[-1] if self.open else self.OUTSIDE
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(
            (a.get("class", ""), a.get("id", ""), a.get("role", "")))).lower()))
        article = top[5] or tag in ("article", "main")
        own = tag not in ("html", "body", "main", "article")
        weak = " ".join([tag, *sorted(words & WEAK_MARKS)]) if own and words & WEAK_MARKS else None
        mark = own and bool(words & MARKS) or weak is not None and not article
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) is not None
        # the title of an article may stand in a header of its own
        by_tag, by_mark = top[2] or tag in DROPPED and not (tag == "header" and article), top[3] or mark or hidden
        weak = top[4] or (weak if article else None)
        if (by_tag, by_mark, weak) != top[2:5]:
            self.flush()
        step = None
        if tag in CONTAINERS:
            classes = sorted({re.sub(r"\d+", "#", c) for c in a.get("class", "").split()})
            step = ".".join([tag, *classes])
        heading = top[6] or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        self.open.append((tag, step, by_tag, by_mark, weak, article, heading, top[7] or tag == "a"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do: only void elements close themselves

    def close_open(self, tags, bounds):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                return self.pop_to(i)
            if self.open[i][0] in bounds:
                return None
        return None

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or self.open[i][2:5] != (self.open[i - 1] if i else self.OUTSIDE)[2:5]:
                    return self.pop_to(i)
                del self.open[i]  # an inline end tag leaves the blocks inside it open
                return None
            if tag not in BLOCKS and self.open[i][0] in BLOCKS:
                return None
        return None

    def handle_data(self, data):
        self.parts.append(data)
        if self.open and self.open[-1][7]:
            self.linked += len(data.strip())


def parsed_blocks(html: str) -> list[tuple]:
    """``(container path, weak mark, heading, text, characters in links)`` of
    the blocks that may be article text.  If marks would leave nothing, only
    tags decide."""
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    kept = [b for b in p.blocks if not b[1] and not b[2]]
    if not any(not b[3] for b in kept):
        kept = kept or [b for b in p.blocks if not b[1]]
        return [(b[0], None, *b[4:]) for b in kept]
    return [(b[0], *b[3:]) for b in kept]


def mark_votes(blocks: list[tuple]) -> dict[str, int]:
    """What a page says about each weak mark: 1 if most characters below it
    stand in paragraphs that are not mostly links, headings aside, else -1."""
    chars: dict[str, list[int]] = {}
    for _, weak, heading, text, linked in blocks:
        if weak and not heading:
            n = chars.setdefault(weak, [0, 0])
            n[0] += len(text)
            n[1] += len(text) if len(text) >= PARAGRAPH and 2 * linked < len(text) else 0
        elif weak:
            chars.setdefault(weak, [0, 0])
    return {w: 1 if 2 * like > n else -1 for w, (n, like) in chars.items()}


def page_blocks(html: str, article_marks: frozenset | None = None) -> list[tuple]:
    """``(container path, text, characters in links)`` of the blocks that may
    be article text; what is weakly marked is one if its mark is among
    ``article_marks`` (by default: as the page itself votes)."""
    blocks = parsed_blocks(html)
    if article_marks is None:
        article_marks = frozenset(w for w, v in mark_votes(blocks).items() if v > 0)
    return [(b[0], b[3], b[4]) for b in blocks if b[1] is None or b[1] in article_marks]


def container_scores(blocks: list[tuple]) -> dict[str, float]:
    """Containers by generalised path: their share of the page's article-like
    characters (blocks that are mostly links count nothing); a semantic
    article element and, of equals, the deeper container scores higher."""
    chars: dict[tuple, int] = {}
    total = 0
    for path, text, linked in blocks:
        n = len(text) if 2 * linked < len(text) else 0
        total += n
        for i in range(1, len(path) + 1):
            chars[path[:i]] = chars.get(path[:i], 0) + n
    out = {}
    for path, n in chars.items():
        if total and 2 * n >= total:
            tag = path[-1].split(".")[0]
            out[" ".join(path)] = n / total + (0.5 if tag in ("article", "main") else 0) + 0.01 * len(path)
    return out


def page_text(blocks: list[tuple], path: str | None) -> str:
    """The blocks within the winning path, or within the page's own best one
    where it has no such container, joined by blank lines."""
    def within(path):
        steps = tuple(path.split(" "))
        return [t for p, t, _ in blocks if p[:len(steps)] == steps]

    texts = within(path) if path else []
    if not texts:
        scores = container_scores(blocks)
        best = max(scores, key=lambda k: (scores[k], k)) if scores else None
        texts = within(best) if best else [t for _, t, _ in blocks]
    return "\n\n".join(texts)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)`` of every page.

    Pages score their containers; per host, Spark adds the scores of equal
    generalised tag-class paths (partial sums first, so a host with a third
    of all pages sends as little as any), and votes on what stands inside
    articles under class words that may mark either (tag and words, so few a
    host); each page is then extracted anew with its host's winning path and
    marks.  The winners, one row a host, are joined as a stored table: Spark
    broadcasts it only while its size allows.

    Null or empty html gives an empty text; pages without a host form one
    host; null or repeated ids and repeated rows each keep a row; an empty
    table gives no rows; other columns are not read."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), host.alias("_host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))

    def vote(batches):
        for b in batches:
            total: dict[tuple, int] = {}
            for h, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blocks = parsed_blocks(html.as_py())
                marks = mark_votes(blocks)
                own = [(p, t, n) for p, w, _, t, n in blocks if w is None or marks[w] > 0]
                scores = [((h, path, False), round(1000 * s)) for path, s in container_scores(own).items()]
                for key, v in scores + [((h, w, True), v) for w, v in marks.items()]:
                    total[key] = total.get(key, 0) + v
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
                                             + [pa.array(total.values(), pa.int64())], ["_vhost", "path", "mark", "votes"])

    votes = (rows.select("_host", "_html").mapInArrow(vote, "_vhost string, path string, mark boolean, votes bigint")
             .groupBy("_vhost", "path", "mark").agg(F.sum("votes").alias("votes")))
    best = F.max_by(F.when(~F.col("mark"), F.col("path")), F.when(~F.col("mark"), F.struct("votes", "path")))
    marks = F.collect_set(F.when(F.col("mark") & (F.col("votes") > 0), F.col("path")))
    winners = written(votes.groupBy("_vhost").agg(best.alias("path"), marks.alias("marks")), "host-paths")

    def extract(batches):
        for b in batches:
            texts = [page_text(page_blocks(h.as_py(), frozenset(m.as_py() or ())), p.as_py())
                     for h, p, m in zip(b.column(2), b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])

    joined = rows.join(winners, rows["_host"] == winners["_vhost"], "left").select("_id", "_url", "_html", "path", "marks")
    out = joined.mapInArrow(extract, f"_id {rows.schema['_id'].dataType.simpleString()}, _url string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
