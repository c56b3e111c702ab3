"""Main text of HTML pages: a recurrent block labeller.

A page is a sequence of leaf blocks. A block is read as the hashed embeddings of
its tag path (tags, class and id words), those of its words, and a few numbers; a
bidirectional LSTM in numpy runs over the whole sequence, so that every block is
labelled with the document before and after it in view. Blocks labelled as
article text are joined by line ends.

There are no labelled pages, so the labeller is trained here on pages that
`synthetic_pages` composes: articles among menus, headers, footers, sidebars,
notices, adverts, forms and comments, in varying markup, damaged as real pages
are. Training takes some seconds on the driver, its seed is fixed, and the weights
(under 1 MB) are broadcast.

Defined results
    null or empty html       empty text
    no article block         empty text
    very long pages          all blocks; memory follows the page
    repeated rows            each gets its own row
    null page_id or url      carried along
    broken markup            read tolerantly, see html_blocks
    empty table              empty result
    other columns            ignored
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, take
from .html_blocks import N_NUMBERS, PATH_BUCKETS, WORD_BUCKETS, Block, Path, blocks, numbers, word_buckets

PATH_DIM, OWN_DIM, WORD_DIM, HIDDEN = 12, 8, 8, 16
INPUT = PATH_DIM + OWN_DIM + WORD_DIM + N_NUMBERS
#: Blocks that are labelled together (pages padded to one length).
BATCH_BLOCKS = 8_000
SEED, TRAINING_PAGES, EPOCHS, BATCH_PAGES = 11, 700, 14, 20

# ---- synthetic pages -------------------------------------------------------

#: Class names by region (fixed words of web templates).
NAMES = {
    "nav": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager tabs toolbar skip",
    "header": "header masthead banner topbar branding site-header logo tagline",
    "footer": "footer site-footer colophon bottom copyright legal credits foot",
    "aside": "sidebar side aside widget rail related recommended trending popular archive tags tagcloud categories author-box",
    "notice": "cookie cookies consent gdpr notice alert warning message popup modal overlay toast paywall banner-notice",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp banner-ad commercial affiliate",
    "form": "form login signup subscribe newsletter search contact register comment-form",
    "comments": "comments comment reply respond replies discussion disqus responses thread",
    "share": "share social sharing follow buttons bookmarks meta byline-share tools",
    "main": "article content post entry story main body text post-content entry-content article-body page-content prose",
    "wrap": "container wrapper wrap row col inner layout site page grid box section outer block",
}
#: Typical words of regions that aren't the article.
PHRASES = {
    "nav": "Home About Contact Products Services Blog News Sign in Log out Search Menu Next Previous Back Category Archive Help FAQ Shop Cart Account More",
    "header": "Welcome Menu Search Home Official site Since Edition Today",
    "footer": "© Copyright All rights reserved Privacy Policy Terms of Use Imprint Sitemap Contact Powered by Follow us Company · |",
    "aside": "Related posts Read more Popular Most read Recent Tags Categories Archive You may also like Recommended See also Author",
    "notice": "We use cookies to improve your experience Accept Decline By continuing you agree Learn more This site Please enable JavaScript Notice Dismiss",
    "ad": "Advertisement Sponsored Buy now Sale Special offer Discount Save Free shipping Limited time Order today Click here Promoted",
    "form": "Name Email Password Subscribe Submit Send Sign up Required Your message Newsletter Enter your address Remember me Search",
    "comments": "Reply says Comments Leave a comment Posted by ago Like Report Anonymous Thanks I agree Great post responses",
    "share": "Share Tweet Facebook Print Email Link Copy Follow Like Pin Save min read views",
}
_SYLLABLES = "an the er in on re th ti en es or st ar al it at le de ra la un ne se lo mo ka vi du pa ser ion ment que eau ich ung sch ció ñ é ü".split()


class Composer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(400)]
        self.semantic = rng.random() < 0.7  # section tags
        self.named = rng.random() < 0.85 or not self.semantic  # class names

    def sentence(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        out = [self.rng.choice(self.words) for _ in range(n)]
        if self.rng.random() < 0.3 and n > 4:
            out[self.rng.randrange(n - 1)] += ","
        if self.rng.random() < 0.08:
            out = [w + self.rng.choice(["###", "$$$", " |", "!!", "***", ""]) for w in out]
        if self.rng.random() < 0.04:
            out = out[:1] * len(out)
        return " ".join(out).capitalize() + self.rng.choice([".", ".", ".", "?", "!", ""])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence(1, 18) for _ in range(self.rng.randint(low, high)))

    def phrase(self, kind: str) -> str:
        words = PHRASES[kind].split()
        at = self.rng.randrange(len(words))
        return " ".join(words[at : at + self.rng.randint(1, 4)])

    def mixed(self, kind: str) -> str:
        r = self.rng.random()
        if r < 0.4:
            return self.phrase(kind)
        if r < 0.75:
            return f"{self.phrase(kind)} {self.sentence(2, 12)}"
        return self.prose(1, 3)

    def attrs(self, kind: str) -> str:
        if not self.named:
            return ""
        names = [self.rng.choice(NAMES[kind].split())]
        if self.rng.random() < 0.3:
            names.append(self.rng.choice(NAMES["wrap"].split()) + self.rng.choice(["", "-1", "__x"]))
        return f' {self.rng.choice(["class", "class", "class", "id"])}="{" ".join(names)}"'

    def inline(self, text: str) -> str:
        r = self.rng.random()
        if r < 0.12:
            cut = len(text) // 2
            return f"<b>{text[:cut]}</b>{text[cut:]}"
        if r < 0.2:
            return f'{text} <a href="/x">{self.sentence(1, 3)}</a> {self.sentence(1, 6)}'
        if r < 0.3:
            return f"<b>{text}<br>"  # left open
        return text

    def article(self) -> str:
        r, parts = self.rng, []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.sentence(2, 12)}</h1>")
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.72:
                close = "</p>" if r.random() < 0.85 else ""
                parts.append(f"<p>{self.inline(self.prose())}{close}")
            elif k < 0.8:
                parts.append(f"<h{r.randint(2, 4)}>{self.sentence(1, 8)}</h2>".replace("</h2>", f"</h{r.randint(2, 4)}>"))
            elif k < 0.87:
                t = r.choice(["ul", "ol"])
                parts.append(f"<{t}>" + "".join(f"<li>{self.sentence(2, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.91:
                parts.append(f"<blockquote>{self.prose(1, 2)}</blockquote>")
            elif k < 0.94:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.sentence(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif k < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence(3, 10)}</figcaption></figure>")
            else:
                parts.append(f"<pre>{self.sentence(4, 20)}</pre>")
            if r.random() < 0.06:  # something that doesn't belong stands inside
                kind = r.choice(["ad", "share", "aside", "notice", "form"])
                parts.append(f'<div{self.attrs(kind) or f" class={kind}"} data-label="0">{self.region(kind)}</div>')
        tag = r.choice(["article", "article", "article", "main", "section"]) if self.semantic else "div"
        attrs = self.attrs("main") if tag == "div" or r.random() < 0.4 else ""
        return f'<{tag}{attrs} data-label="1">{"".join(parts)}</{tag}>'

    def region(self, kind: str) -> str:
        r = self.rng
        if kind == "nav" or (kind in ("aside", "footer", "header", "share") and r.random() < 0.4):
            words = [self.phrase(kind) if r.random() < 0.5 else self.sentence(1, 2).rstrip(".?!") for _ in range(r.randint(2, 9))]
            if r.random() < 0.7:
                return "<ul>" + "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(words)) + "</ul>"
            return " ".join(f'<a href="/{i}">{w}</a>' for i, w in enumerate(words))
        if kind == "comments":
            return "".join(f"<div{self.attrs('comments')}><p>{self.phrase('comments')}</p><p>{self.prose(1, 3)}</p></div>" for _ in range(r.randint(1, 5)))
        if kind == "form":
            choice = "<select>" + "".join(f"<option>{self.phrase('form')}" for _ in range(3)) + "</select>" if r.random() < 0.3 else ""
            return f"<form><label>{self.phrase('form')}</label><input>{choice}<button>{self.phrase('form')}</button>{self.mixed('form')}</form>"
        if kind == "notice" and r.random() < 0.2:
            return f"<noscript>{self.mixed('notice')}</noscript>"
        if kind == "footer" and r.random() < 0.5:
            return f"&copy; {r.choice(self.words)}.example.com &middot; {self.sentence(2, 12)}"
        tag = r.choice(["p", "div", "span", "p"])
        return "".join(f"<{tag}>{self.mixed(kind)}</{tag}>" for _ in range(r.randint(1, 3))) if r.random() < 0.6 else self.mixed(kind)

    def around(self, kind: str) -> str:
        tags = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}
        tag = tags.get(kind, "div") if self.semantic else "div"
        if tag == "div" and kind != "form" and not self.named:
            tag = tags.get(kind, "div")
        attrs = self.attrs(kind) if tag == "div" or self.rng.random() < 0.4 else ""
        if tag == "div" and not attrs and kind != "form":
            attrs = f' class="{self.rng.choice(NAMES[kind].split())}"'
        return f'<{tag}{attrs} data-label="0">{self.region(kind)}</{tag}>'

    def page(self) -> str:
        r = self.rng
        before = [k for k in ("notice", "header", "nav", "ad", "share", "form") if r.random() < {"nav": 0.8, "header": 0.5, "ad": 0.45}.get(k, 0.25)]
        after = [k for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if r.random() < {"footer": 0.85, "comments": 0.4, "aside": 0.4}.get(k, 0.25)]
        r.shuffle(before)
        body = [self.around(k) for k in before]
        middle = self.article()
        for _ in range(r.randint(0, 3)):
            middle = f"<div{self.attrs('wrap')}>{middle}{self.around('aside') if r.random() < 0.15 else ''}</div>"
        body += [middle, *[self.around(k) for k in after]]
        head = f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title><script>var t='</p>';</script></head>"
        return f"{head}<body>{''.join(body)}" + ("</body></html>" if r.random() < 0.9 else "")


def synthetic_pages(n: int, seed: int = SEED) -> list[list[Block]]:
    rng = random.Random(seed)
    return [found for found in (blocks(Composer(rng).page()) for _ in range(n)) if found]


# ---- the network -----------------------------------------------------------


def shares(lists: list[list[int]], buckets: int) -> np.ndarray:
    out = np.zeros((len(lists), buckets), np.float32)
    for row, found in zip(out, lists, strict=True):
        if found:
            row += np.bincount(found, minlength=buckets).astype(np.float32) / len(found)
    return out


class Labeller:
    """Embeddings, two LSTMs and a logistic output."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)

        def init(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape)

        self.p = {"path": init(PATH_BUCKETS, PATH_DIM, scale=0.5), "own": init(PATH_BUCKETS, OWN_DIM, scale=0.5), "word": init(WORD_BUCKETS, WORD_DIM, scale=0.5)}
        for d in "fb":
            self.p["w" + d] = init(INPUT + HIDDEN, 4 * HIDDEN, scale=0.2)
            self.p["c" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.p["out"] = init(2 * HIDDEN, scale=0.2)
        self.p["bias"] = np.zeros(1)

    def inputs(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """What the network reads: for each page, a row for each block."""
        path, own, word = (self.p[k].astype(np.float32) for k in ("path", "own", "word"))
        sums_of: dict[int, np.ndarray] = {}  # by path: the sum of its tokens' embeddings
        known: dict[int, np.ndarray] = {}
        none = np.zeros(PATH_DIM + OWN_DIM, np.float32)

        def read_path(node: Path) -> np.ndarray:
            chain = []
            while node.above is not None and id(node) not in sums_of:
                chain.append(node)
                node = node.above
            total = sums_of.get(id(node), none[:PATH_DIM])
            for node in reversed(chain):
                total = sums_of[id(node)] = total + path[list(node.tokens)].sum(axis=0)
            return np.concatenate([total / max(node.count, 1), own[list(node.tokens)].mean(axis=0)]) if node.count else none

        words: list[int] = []
        starts, paths, rest = [], [], []
        for page in pages:
            for i, b in enumerate(page):
                if id(b.path) not in known:
                    known[id(b.path)] = read_path(b.path)
                starts.append(len(words))
                words += word_buckets(b.text) or [0]
                paths.append(known[id(b.path)])
                rest.append(numbers(b, i, len(page)))
        sums = np.add.reduceat(word[words], starts, axis=0) / np.diff([*starts, len(words)])[:, None]
        x = np.concatenate([paths, sums, np.array(rest)], axis=1, dtype=np.float32)
        return np.split(x, np.cumsum([len(page) for page in pages])[:-1])

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x (steps, pages, INPUT), mask (steps, pages): hidden states of one direction."""
        w, c = self.p["w" + d], self.p["c" + d]
        w, c = w.astype(x.dtype), c.astype(x.dtype)
        h, s, out = np.zeros((x.shape[1], HIDDEN), x.dtype), np.zeros((x.shape[1], HIDDEN), x.dtype), np.empty((*x.shape[:2], HIDDEN), x.dtype)
        ahead = x @ w[:INPUT] + c
        for t in range(len(x)):
            z = ahead[t] + h @ w[INPUT:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            s2 = f * s + i * g
            u = np.tanh(s2)
            m = mask[t][:, None]
            h2, s2 = m * (o * u) + (1 - m) * h, m * s2 + (1 - m) * s
            if keep is not None:
                keep.append((h, s, i, f, o, g, u, m))
            h, s = h2, s2
            out[t] = h
        return out

    def back(self, x: np.ndarray, dout: np.ndarray, d: str, keep: list, grad: dict) -> np.ndarray:
        w = self.p["w" + d]
        gw, gc, dx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.empty_like(x)
        dh, ds = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        for t in range(len(x) - 1, -1, -1):
            h, s, i, f, o, g, u, m = keep[t]
            dh = dh + dout[t]
            live = m * dh
            dst = m * ds + live * o * (1 - u * u)
            z = np.concatenate([dst * g * i * (1 - i), dst * s * f * (1 - f), live * u * o * (1 - o), dst * i * (1 - g * g)], axis=1)
            gw[:INPUT] += x[t].T @ z
            gw[INPUT:] += h.T @ z
            gc += z.sum(axis=0)
            dx[t] = z @ w[:INPUT].T
            dh = (1 - m) * dh + z @ w[INPUT:].T
            ds = (1 - m) * ds + dst * f
        grad["w" + d], grad["c" + d] = gw, gc
        return dx

    @staticmethod
    def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, pages, width), its mask, and for each page the order that turns it round."""
        longest, n, kind = max(map(len, parts)), len(parts), parts[0].dtype
        x, mask, turn = np.zeros((longest, n, parts[0].shape[1]), kind), np.zeros((longest, n), kind), np.tile(np.arange(longest)[:, None], (1, n))
        for k, part in enumerate(parts):
            x[: len(part), k], mask[: len(part), k] = part, 1
            turn[: len(part), k] = np.arange(len(part))[::-1]
        return x, mask, turn

    def logits(self, x: np.ndarray, mask: np.ndarray, turn: np.ndarray) -> np.ndarray:
        pages = np.arange(x.shape[1])
        both = np.concatenate([self.run(x, mask, "f"), self.run(x[turn, pages], mask, "b")[turn, pages]], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def train(self, pages: list[list[Block]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        rng, moments, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        data = []
        for found in pages:
            data.append((
                shares([b.path.flat() for b in found], PATH_BUCKETS),
                shares([list(b.path.tokens) for b in found], PATH_BUCKETS),
                shares([word_buckets(b.text) for b in found], WORD_BUCKETS),
                np.array([numbers(b, i, len(found)) for i, b in enumerate(found)]),
                np.array([float(b.label or 0) for b in found]),
            ))
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            rate = 0.012 * (1 - epoch / epochs) + 0.001
            for at in range(0, len(order), BATCH_PAGES):
                some = [data[k] for k in order[at : at + BATCH_PAGES]]
                parts = [np.c_[a @ self.p["path"], b @ self.p["own"], c @ self.p["word"], n] for a, b, c, n, _ in some]
                x, mask, turn = self.padded(parts)
                pages_at, keep_f, keep_b = np.arange(x.shape[1]), [], []
                x_back = x[turn, pages_at]
                fwd, bwd = self.run(x, mask, "f", keep_f), self.run(x_back, mask, "b", keep_b)
                both = np.concatenate([fwd, bwd[turn, pages_at]], axis=2)
                y = np.zeros(mask.shape)
                for k, part in enumerate(some):
                    y[: len(part[4]), k] = part[4]
                z = np.clip(both @ self.p["out"] + self.p["bias"], -30, 30)
                dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
                grad: dict[str, np.ndarray] = {"out": np.einsum("tb,tbh->h", dz, both), "bias": np.array([dz.sum()])}
                dboth = dz[:, :, None] * self.p["out"]
                dx = self.back(x, dboth[:, :, :HIDDEN], "f", keep_f, grad)
                dx += self.back(x_back, dboth[:, :, HIDDEN:][turn, pages_at], "b", keep_b, grad)[turn, pages_at]
                grad |= {k: np.zeros_like(self.p[k]) for k in ("path", "own", "word")}
                for k, (a, b, c, _, own_y) in enumerate(some):
                    d = dx[: len(own_y), k]
                    grad["path"] += a.T @ d[:, :PATH_DIM]
                    grad["own"] += b.T @ d[:, PATH_DIM : PATH_DIM + OWN_DIM]
                    grad["word"] += c.T @ d[:, PATH_DIM + OWN_DIM : -N_NUMBERS]
                step += 1
                for k, g in grad.items():
                    m1, m2 = moments[k]
                    m1 += 0.1 * (g - m1)
                    m2 += 0.01 * (g * g - m2)
                    self.p[k] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks are article text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, at = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= BATCH_BLOCKS:
                end += 1
            some = order[at:end]
            z = self.logits(*self.padded(self.inputs([pages[k] for k in some])))
            for j, k in enumerate(some):
                out[k] = z[: len(pages[k]), j] > 0
            at = end
        return out


@functools.cache
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    return Labeller(seed).train(synthetic_pages(pages, seed), epochs, seed)


# ---- the operator ----------------------------------------------------------


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_blocks, n_kept for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                root = Path()
                found = [blocks(x.as_py(), root) for x in b.column(2)]
                keep = shared.value.label(found)
                texts = ["\n".join(x.text for x, k in zip(page, flags, strict=True) if k) for page, flags in zip(found, keep, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array([int(k.sum()) for k in keep], pa.int64())],
                    ["page_id", "url", "text", "n_blocks", "n_kept"],
                )

    rows = take(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_blocks bigint, n_kept bigint")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
