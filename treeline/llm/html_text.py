"""Main text of web pages by a recurrent block labeller (numpy).

A page is scanned once into leaf blocks: runs of text between block-level tags,
with the tags, classes, ids and roles of their open ancestors.  A block's input
vector joins the sum of its path tokens' (hashed) embeddings, the mean of fixed
hashed word vectors over all its words, and a few figures.  A bidirectional LSTM
reads a page's blocks in order and a logistic layer over both states and the
input classifies every block; kept blocks are joined by line feeds.

The labeller is trained on at most ``PAGES`` pages of the table (those whose key's
hash is lowest; a bounded sample), labelled by what their markup says, on half of
them again without the tokens that say so, and on generated pages whose truth is
known: many name their parts, many have classes that say nothing, some mislead.

Defined cases: null and empty html give the empty text; repeated rows are each
extracted; an empty table gives an empty result; scanning takes linear time and
keeps whole pages; other columns pass through, and the added ones replace ones of
the same name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash64, read, slices, tidy, words_of

#: HTML elements by their role in the scan.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
#: Foreign elements whose content is no text of the page (a formula's annotation is not shown); the start tags that end
#: foreign content, and the elements in it that may hold such tags.
FOREIGN = frozenset("svg annotation annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS = frozenset("foreignobject desc title annotation-xml".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Tokens that tell main text and its surroundings in the training pages.
MAIN = frozenset("article main".split())
OTHER = frozenset(
    "nav header footer aside form button select dialog menu sidebar ad ads advert advertisement sponsor sponsored banner promo promotion cookie cookies consent notice notices"
    " alert comment comments reply replies disqus breadcrumb breadcrumbs share sharing social related recommended widget popup modal newsletter subscribe signup login search"
    " navigation navbar topbar toolbar pagination pager copyright legal masthead skip hidden complementary contentinfo".split()
)

TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z]+")

PAGES, MADE = 300, 700
#: Marks main text of generated pages (a private-use character).
TRUE = "\ue000"
TOKENS, PATH, WORDS, FIGURES, HIDDEN = 1024, 16, 8, 5, 12
LONGEST = 1000  # distinct tokens of a path
EPOCHS, BATCH, WINDOW = 14, 32, 64


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """The element's name and what its class, id and role are made of."""
    found = [tag]
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "hidden" or (name.lower() == "style" and "display:none" in value.replace(" ", "")):
                found.append("hidden")
            elif name.lower() != "style":
                found += [t for t in SPLIT.split(value) if t]
    return tuple(found)


def _grown(path: tuple[str, ...], own: tuple[str, ...]) -> tuple[str, ...]:
    """A path holds each token once, so that it is as long as its tokens are many, not
    as its elements are deep; past ``LONGEST`` only tokens that tell parts are added."""
    new = [t for t in dict.fromkeys(own) if t not in path]
    if len(path) + len(new) > LONGEST:
        new = [t for t in new if t in MAIN or t in OTHER]
    return (*path, *new) if new else path


def _after_foreign(page: str, at: int, name: str, around: Counter) -> int:
    """Where a foreign element that is open at ``at`` ends: after its end tag, or
    without one before its parent's end tag or a start tag that can't be in it."""
    opened = Counter([name])
    while m := TAG.search(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                opened[tag] -= 1
                if tag == name and not opened[tag]:
                    return at
            elif tag in INLINE or tag in ("p", "br") or around[tag]:
                return m.start()
        elif tag in BREAKOUT and not any(opened[x] for x in HOLDS):
            return m.start()
        elif tag not in VOID and not m[3].endswith("/"):
            opened[tag] += 1
    return len(page)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(distinct path tokens, text, characters in links) of every leaf block, in order.

    The time is linear in the page: open names are counted, so an end tag that
    closes nothing is passed over at once, and each element is popped once.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    around: Counter = Counter()
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((stack[-1][1] if stack else (), text, linked))
        linked = 0

    while m := TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name == "br":
                parts.append(" ")
            elif name not in INLINE and name not in VOID:
                flush()
                while around[name]:
                    last, _ = stack.pop()
                    around[last] -= 1
                    if last == name:
                        break
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name in FOREIGN:
            if not m[3].endswith("/"):
                at = _after_foreign(page, at, name, around)
        elif name == "a":
            in_link += 1
        elif name in VOID:
            if name in ("br", "wbr", "img", "input"):
                parts.append(" " if name != "wbr" else "")
            elif name == "hr":
                flush()
        elif name not in INLINE:
            flush()
            in_link = 0
            while stack and stack[-1][0] in CLOSES.get(name, ()):
                around[stack.pop()[0]] -= 1
            if stack and stack[-1][0] == "p" and name not in ("p", "object", "canvas"):
                around[stack.pop()[0]] -= 1
            stack.append((name, _grown(stack[-1][1] if stack else (), _tokens(name, m[3]))))
            around[name] += 1
    parts.append(page[at:])
    flush()
    return out


def told_by_markup(paths: list[tuple[str, ...]]) -> np.ndarray:
    """Training labels: in the page's main container, if it has one, and under
    nothing that surrounds main text."""
    inside = [bool(MAIN.intersection(p)) for p in paths]
    return np.array([not OTHER.intersection(p) and (i or not any(inside)) for p, i in zip(paths, inside, strict=True)], dtype=np.float32)


class Encoder:
    """Input vectors of blocks, apart from the path embeddings."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, tokens: tuple[str, ...]) -> np.ndarray:
        if tokens not in self.rows:
            if len(self.rows) > 50_000:
                self.rows.clear()
            self.rows[tokens] = np.unique((hash64(list(tokens)) % np.uint64(TOKENS)).astype(np.int64)) if tokens else np.zeros(0, np.int64)
        return self.rows[tokens]

    def figures(self, found: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
        words, codes, offsets = words_of(pa.array([t for _, t, _ in found], pa.string()), lower=True)
        bits = hash64(words.to_pylist(), seed=9)[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(7))[None]
        vector = ((bits & np.uint64(1)).astype(np.float32) * 2 - 1) if len(words) else np.zeros((0, WORDS), np.float32)
        count = np.maximum(np.diff(offsets), 1)
        total = np.concatenate([np.zeros((1, WORDS)), np.cumsum(vector[codes], axis=0, dtype=np.float64)])
        mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.sqrt(count)[:, None] / 4
        size = np.array([len(t) for _, t, _ in found], dtype=np.float32)
        links = np.array([min(1.0, n / max(len(t), 1)) for _, t, n in found], dtype=np.float32)
        stops = np.array([t[-1] in ".!?…\"'”»)" for _, t, _ in found], dtype=np.float32)
        depth = np.array([min(len(p), 20) / 10 for p, _, _ in found], dtype=np.float32)
        return np.column_stack([mean, np.log1p(size) / 5, links, stops, depth, np.ones(len(found))]).astype(np.float32)


class Labeller:
    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        width = PATH + WORDS + FIGURES
        self.p = {"path": rng.normal(0, 0.1, (TOKENS, PATH)), "out": rng.normal(0, 0.1, 2 * HIDDEN + width), "shift": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.2, (width, 4 * HIDDEN))
            self.p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, paths: list[np.ndarray], figures: np.ndarray) -> np.ndarray:
        size = np.array([len(x) for x in paths])
        flat = np.concatenate([*paths, np.zeros(0, np.int64)])
        total = np.concatenate([np.zeros((1, PATH), np.float32), np.cumsum(self.p["path"][flat], axis=0)])
        ends = np.cumsum(size)
        return np.column_stack([total[ends] - total[ends - size], figures])

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x (steps, pages, width) -> states (steps, pages, HIDDEN), and what backward needs."""
        steps, pages, _ = x.shape
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"h{d}"]
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            new_c = np.where(on, f * c + i * g, c)
            new_h = np.where(on, o * np.tanh(new_c), h)
            if keep:
                saved.append((t, i, f, o, g, c, h, new_c, on))
            h, c = new_h, new_c
            states[t] = h
        return states, saved

    def _back(self, x, saved, grad, d, g_p):
        gx = np.zeros_like(x)
        gh = gc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, i, f, o, g, c, h, new_c, on in reversed(saved):
            dh = gh + grad[t]
            tc = np.tanh(new_c)
            dc = gc + dh * o * (1 - tc * tc)
            z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1) * on
            g_p[f"x{d}"] += x[t].T @ z
            g_p[f"h{d}"] += h.T @ z
            g_p[f"c{d}"] += z.sum(axis=0)
            gx[t] = z @ self.p[f"x{d}"].T
            gh = np.where(on, z @ self.p[f"h{d}"].T, dh)
            gc = np.where(on, dc * f, gc)
        return gx

    @staticmethod
    def _grid(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(offsets)
        x = np.zeros((int(size.max(initial=0)), len(size), rows.shape[1]), np.float32)
        page = np.repeat(np.arange(len(size)), size)
        x[np.arange(len(rows)) - offsets[:-1][page], page] = rows
        return x, np.arange(len(x))[:, None] < size[None]

    def probabilities(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each block; pages are run together by similar length."""
        out = np.zeros(len(rows), np.float32)
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        at = int(np.searchsorted(size[order], 1))
        while at < len(order):
            most = max(1, 20_000 // int(size[order[min(at + 255, len(order) - 1)]]))
            some = order[at : at + min(256, most)]
            at += len(some)
            pick = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in some])
            x, mask = self._grid(rows[pick], np.concatenate(([0], np.cumsum(size[some]))))
            both = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0], x], axis=2)
            z = both @ self.p["out"] + self.p["shift"]
            out[pick] = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).T[mask.T]
        return out

    def fit(self, pages: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], seed: int = 8) -> None:
        """pages: (path rows of each block, figures, labels)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                some = []
                for k in order[at : at + BATCH]:
                    paths, figures, labels = pages[k]
                    a = int(rng.integers(0, max(1, len(paths) - WINDOW + 1)))
                    some.append((paths[a : a + WINDOW], figures[a : a + WINDOW], labels[a : a + WINDOW]))
                paths = [p for s in some for p in s[0]]
                rows = self.inputs(paths, np.concatenate([s[1] for s in some]))
                offsets = np.concatenate(([0], np.cumsum([len(s[0]) for s in some])))
                x, mask = self._grid(rows, offsets)
                y, _ = self._grid(np.concatenate([s[2] for s in some])[:, None], offsets)
                f, kept_f = self._run(x, mask, "f", True)
                b, kept_b = self._run(x, mask, "b", True)
                both = np.concatenate([f, b, x], axis=2)
                z = both @ self.p["out"] + self.p["shift"]
                error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[:, :, 0]) * mask / max(mask.sum(), 1)).astype(np.float32)
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                g["out"] = np.einsum("tpw,tp->w", both, error)
                g["shift"][0] = error.sum()
                back = error[:, :, None] * self.p["out"]
                gx = back[:, :, 2 * HIDDEN :] + self._back(x, kept_f, back[:, :, :HIDDEN], "f", g) + self._back(x, kept_b, back[:, :, HIDDEN : 2 * HIDDEN], "b", g)
                flat = np.concatenate([gx[: offsets[i + 1] - offsets[i], i] for i in range(len(some))])
                np.add.at(g["path"], np.concatenate([*paths, np.zeros(0, np.int64)]), np.repeat(flat[:, :PATH], [len(p) for p in paths], axis=0))
                step += 1
                for k, v in self.p.items():
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.01 * (g[k] * g[k] - second[k])
                    v -= 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)


def skeletons(words: list[str], count: int, seed: int = 6, neutral: float = 0.4, misleading: float = 0.05) -> list[str]:
    """Generated pages: main text and its surroundings in many combinations, every
    piece of main text behind a ``TRUE`` mark.  Of ``neutral`` pages the classes and
    ids say nothing, and no element names the parts, so text, links and neighbours
    must tell them; of ``misleading`` pages main text stands in a container whose
    class names its surroundings."""
    rng = np.random.default_rng(seed)
    words = words or ["text"]
    other = sorted(OTHER - {"hidden"})
    tags = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
    silent = False

    def prose(low: int, high: int) -> str:
        return " ".join(words[i] for i in rng.integers(0, len(words), rng.integers(low, high))).capitalize() + ("." if rng.random() < 0.8 else "")

    def some_class() -> str:
        return "".join(chr(97 + k) for k in rng.integers(0, 26, 5))

    def around() -> str:
        t = other[rng.integers(0, len(other))]
        if silent:
            tag = ("div", "section", "ul", "div", "p")[rng.integers(0, 5)]
            start, end = f'<{tag} class="{some_class()}">', f"</{tag}>"
        elif t in tags and rng.random() < 0.7:
            start, end = f"<{t}>", f"</{t}>"
        else:
            tag = ("div", "section", "ul", "div", "p")[rng.integers(0, 5)]
            start, end = f'<{tag} {"class" if rng.random() < 0.7 else "id"}="{t}{"-box" if rng.random() < 0.3 else ""}">', f"</{tag}>"
        if rng.random() < (0.9 if silent else 0.4):
            inner = "<ul>" * (tag_free := "<ul" not in start) + "".join(f'<li><a href="/">{prose(1, 4).rstrip(".")}</a></li>' for _ in range(rng.integers(2 if silent else 1, 6))) + "</ul>" * tag_free
        else:
            shape = "{}" if start.startswith("<p") else ("<p>{}</p>", "{}", "<div>{}</div>", "<h2>{}</h2>")[rng.integers(0, 4)]
            inner = "".join(shape.format(prose(1, 6).rstrip(".") if silent else prose(2, 40)) for _ in range(rng.integers(1, 4)))
        return start + inner + end

    def text() -> str:
        kinds = ["<p>{}</p>"] * 6 + ["<h1>{}</h1>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p>{}<br>", "<table><tr><td>{}</td></tr></table>", "<p><b>{}", "<p><a href='#'>{}</a></p>", "<div>{}</div>", "<pre>{}</pre>"]
        return kinds[rng.integers(0, 6 if silent else len(kinds))].format(TRUE + prose(12 if silent else 1, 60))

    pages = []
    for _ in range(count):
        kind = rng.random()
        silent = kind < neutral
        misled = not silent and kind < neutral + misleading
        body = [around() for _ in range(rng.integers(0, 4))]
        main = "".join(around() if rng.random() < 0.15 and not silent else text() for _ in range(rng.integers(2 if silent else 1, 14)))
        style = rng.integers(0, 5)
        frame = ["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class='content'>{}</div>", "{}"][style]
        if silent:
            style, frame = 4, ("<div class='" + some_class() + "'>{}</div>", "{}")[rng.integers(0, 2)]
        elif misled:
            style, frame = 0, "<article><div class='" + ("promo", "banner", "social", "related")[rng.integers(0, 4)] + "-story'>{}</div></article>"
            main = "".join(f"<p>{TRUE}{prose(15, 60)}</p>" for _ in range(rng.integers(3, 9)))
        after = [around() for _ in range(rng.integers(0, 4))]
        if style < 3 and rng.random() < 0.3:
            after.append(f"<div class='box'><p>{prose(2, 20)}</p></div>")
        pages.append("<html><head><title>t</title></head><body>" + "".join([*body, frame.format(main), *after]) + "</body></html>")
    return pages


def labelled(page: str) -> tuple[list[tuple[tuple[str, ...], str, int]], np.ndarray]:
    """Blocks of a generated page and whether each is main text."""
    found = blocks(page)
    return [(p, t.replace(TRUE, ""), n) for p, t, n in found], np.array([TRUE in t for _, t, _ in found], dtype=np.float32)


def train(pages: list[str]) -> Labeller:
    """Fit on a bounded sample of real pages, labelled by their markup, the same
    without the tokens that label them, and generated pages, whose truth is known."""
    scanned = [b for b in map(blocks, pages) if b]
    words = sorted({w for b in scanned[:40] for _, t, _ in b for w in t.split()[:50]})[:2000]
    told = [(b, told_by_markup([p for p, _, _ in b])) for b in scanned]
    plain = [([(tuple(t for t in p if t not in MAIN and t not in OTHER), text, n) for p, text, n in b], y) for b, y in told[::2]]
    made = [x for x in map(labelled, skeletons(words, MADE)) if x[0]]
    encoder = Encoder()
    net = Labeller()
    net.fit([([encoder.path(p) for p, _, _ in b], encoder.figures(b), y) for b, y in [*told, *plain, *made]])
    return net


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Every row of ``pages`` without html, with ``text`` and ``n_chars`` added."""
    place = F.xxhash64(F.col(key))
    last = pages.where(F.col(html).isNotNull()).select(place.alias("h")).orderBy("h").limit(PAGES).agg(F.max("h")).first()[0]  # a bound first, so that only the chosen pages travel
    few = pages.where(F.col(html).isNotNull() & (place <= F.lit(last))).select(html).limit(PAGES).collect() if last is not None else []
    net = train([r[html] for r in few])
    inner = pages.select(F.coalesce(F.col(html), F.lit("")).alias("_html"), F.struct(*[c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]).alias("_row"))
    schema = inner.select("_row").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in slices(batches, "_html"):
            found = [blocks(x) for x in b.column("_html").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            flat = [x for page in found for x in page]
            keep = net.probabilities(net.inputs([encoder.path(p) for p, _, _ in flat], encoder.figures(flat)), offsets) >= 0.5 if flat else np.zeros(0, bool)
            texts = ["\n".join(t for (_, t, _), k in zip(page, keep[a : a + len(page)], strict=True) if k) for page, a in zip(found, offsets[:-1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_row", "text", "n_chars"])

    return inner.mapInArrow(run, schema).select("_row.*", "text", "n_chars")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
