"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: text between block-level tags, with its path of open elements. What never is text
(head, scripts, styles, templates, form controls, comments) goes at once. A bidirectional LSTM in numpy reads the
page's whole sequence of blocks, each as a vector of hashed path elements (tags, classes, ids, roles), hashed
words and a few measures, and labels every block as article or not with both sides as context.

The model is trained here, on pages from ``training_page``: a seeded generator of layouts in invented
words, with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around, between
and inside articles under many names. Training takes a bounded number of pages (PAGES), the same every time.

Rows: null or empty html gives an empty text. Broken markup is read as far as it goes: tags may stay open,
end tags may have no partner, scripts and comments without an end reach the end of the page. Repeated rows, ties and
null ids stay. Pages of any length are labelled whole, in time that grows as they do, at any depth of open elements, whose names all count. A page's open elements
are nodes that its blocks share, and pages of more than AT_ONCE blocks are read in steps that keep HIDDEN numbers a block; so memory grows as the page's own
text and tags do. Of one element's names NAMES at most go into a vector. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: HTML's element kinds.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title select option optgroup datalist button label legend audio video canvas svg iframe noframes noembed noscript".split())
RAW = frozenset("script style template textarea xmp plaintext".split())
#: What a head can hold. It ends before anything else, by its end tag or without.
IN_HEAD = frozenset("title meta link base basefont bgsound script style template noscript noframes head html".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ENDS_P = BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary"}
#: Start tags that close others of their kind, and the elements beyond which they don't.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
#: Names of one element that a vector takes.
NAMES = 64

#: A tag without ``<`` or ``>`` in its quotes: nearly all. A match never looks past the next ``<``.
QUICK = re.compile(r"<(/?)([a-z][^\s/>\"'<]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>", re.I)
NAME, SPECIAL, COMMENT_END = re.compile(r"[a-z][^\s/>]*", re.I), re.compile("[>\"']"), re.compile("--!?>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

PATH, WORD, MEASURES, HIDDEN = 192, 256, 6, 24
WIDTH = PATH + WORD + MEASURES
PAGES, EPOCHS, SEED = 3_000, 6, 11
#: Blocks (padding included) that are labelled at once, and bytes of pages that are parsed at once (one page at least).
AT_ONCE, PARSED = 4_096, 4 << 20
#: Tokens nearest to the block that weigh more.
NEAR = 6


class Node:
    """An element that is or was open: its tag and names as tokens, and the element around it."""

    __slots__ = ("heading", "parent", "tokens")

    def __init__(self, parent: Node | None, tag: str, said: tuple[str, ...]):
        self.parent, self.tokens = parent, (f"<{tag}", *said)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked

    @property
    def path(self) -> tuple[str, ...]:
        """Tokens of all elements around the block, from outside."""
        out, node = [], self.node
        while node:
            out.append(node.tokens)
            node = node.parent
        return tuple(t for tokens in reversed(out) for t in tokens)


def names(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for m in NAMED.finditer(attributes):
        for part in PARTS.finditer(m[2] or m[3] or m[4] or ""):
            if len(out) == NAMES:
                return tuple(out)
            out.append(part[0].lower())
    return tuple(out)


def tags(page: str) -> Iterator[tuple[str, str, str | None, str]]:
    """The text before each tag, ``/`` for an end tag, its name (null: comments and what else is no tag) and attributes; then the last text.

    One pass: a position is looked at a bounded number of times, also in markup whose quotes, tags or comments never end.
    """
    start = at = 0
    more, failed, unclosed = -1, set(), {}  # the next >; quotes from which no tag ends; where no quote of a kind follows

    def end_of(pos: int) -> int:
        """The end of a tag by its quotes; if there is none, at the next >."""
        opened = []
        while m := SPECIAL.search(page, pos):
            x, c = m.start(), m[0]
            if c == ">":
                return x
            if x in failed or unclosed.get(c, x) < x:
                break
            opened.append(x)
            pos = page.find(c, x + 1) + 1
            if not pos:
                unclosed[c] = x
                break
        failed.update(opened)
        return more

    while (lt := page.find("<", at)) >= 0:
        at, name, slash, said = lt + 1, None, "", ""
        if m := QUICK.match(page, lt):
            at, slash, name, said = m.end(), m[1], m[2].lower(), m[3]
        elif page.startswith("<!--", lt):
            m = COMMENT_END.search(page, lt + 4)
            at = m.end() if m else len(page)
        else:
            if more < lt:
                more = page.find(">", lt)
                more = len(page) if more < 0 else more
            if more == len(page):
                continue  # no tag ends any more
            slash = "/" if page.startswith("/", at) else ""
            if m := NAME.match(page, at + len(slash)):
                end = end_of(m.end())
                at, name, said = end + 1, m[0].lower(), page[m.end() : end]
            elif slash or page[at] in "!?":
                at = more + 1
            else:
                continue
        if name in RAW and not slash:
            m = RAW_END[name].search(page, at)
            end = page.find(">", m.end()) if m else -1
            at, name = end + 1 if end >= 0 else len(page), None
        yield page[start:lt], slash, name, said
        start = at
    yield page[start:], "", None, ""


def blocks(page: str) -> list[Block]:
    """Blocks in page order: white space inside is one space, references are decoded, empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []
    where: dict[str, list[int]] = {}  # the places in the stack of each open tag, and of all blocks
    places: list[int] = []
    parts: list[str] = []
    linked, links, silent = 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else None, linked))
            parts = []
        linked = 0

    def pop(k: int) -> None:
        nonlocal links, silent
        while len(stack) > k:
            tag, _ = stack.pop()
            where[tag].pop()
            if tag in BLOCK:
                places.pop()
            links -= tag == "a"
            silent -= tag in SILENT

    def last(tag: str) -> int:
        return where[tag][-1] if where.get(tag) else -1

    def say(raw: str) -> None:
        nonlocal linked
        if silent and stack[-1][0] == "head" and raw.strip():
            pop(len(stack) - 1)
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    for text, slash, tag, said in tags(page):
        say(text)
        if tag is None:
            continue
        if slash:
            if tag in BLOCK:
                flush()
            k = last(tag)
            if k >= 0 and (tag in BLOCK or not places or places[-1] < k):  # an inline end tag doesn't close blocks
                pop(k)
            continue
        if silent and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag == "br":
            say("\n")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES:
                others, stops = CLOSES[tag]
                stop = max(map(last, stops), default=-1)
                first = [where[o][i] for o in others if where.get(o) and (i := bisect_right(where[o], stop)) < len(where[o])]
                if first:
                    pop(min(first))
            if tag in ENDS_P and places and stack[places[-1]][0] == "p":
                pop(places[-1])
        if tag in VOID or said.endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "g"):
            continue
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            places.append(len(stack))
        stack.append((tag, Node(stack[-1][1] if stack else None, tag, names(said) if "=" in said else ())))
        links += tag == "a"
        silent += tag in SILENT
    flush()
    return out


# --- vectors --------------------------------------------------------------------------------------------------


@lru_cache(200_000)
def hashed(token: str, width: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % width, 1.0 if h & 0x10000 else -1.0


def path_sums(node: Node | None, known: dict[Node | None, np.ndarray]) -> np.ndarray:
    """Hashes of all tokens around, and of each with the one before it (the outermost: itself again), added up. ``known`` holds and gets those of the elements on the way."""
    todo = []
    while node not in known:
        todo.append(node)
        node = node.parent
    out = known[node]
    for node in reversed(todo):
        before = node.parent.tokens[-1] if node.parent else None
        out = out.copy()
        for token in node.tokens:
            for form in (token, token if before is None else f"{before}>{token}"):
                i, sign = hashed(form, PATH)
                out[i] += sign
            before = token
        known[node] = out
    return out


def path_vector(node: Node | None, known: dict[Node | None, np.ndarray]) -> np.ndarray:
    """Elements near the block weigh more; every pair of neighbours counts beside the single ones."""
    out, last = path_sums(node, known) / 2, []
    while node and len(last) <= NEAR:
        last = [*node.tokens, *last]
        node = node.parent
    for k in range(max(0, len(last) - NEAR), len(last)):
        for form in (last[k], f"{last[k - 1]}>{last[k]}" if k else last[k]):
            i, sign = hashed(form, PATH)
            out[i] += sign / 2
    return np.tanh(out)


def distinct_paths(page: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each path that occurs, and each block's place among them."""
    known: dict[Node | None, np.ndarray] = {None: np.zeros(PATH, np.float32)}
    seen, out, place = {}, [], np.zeros(len(page), np.int64)
    for k, b in enumerate(page):
        alike = b.node and (b.node.parent, b.node.tokens)  # elements of one name within one element have one path
        if alike not in seen:
            seen[alike] = len(out)
            out.append(path_vector(b.node, known))
        place[k] = seen[alike]
    return np.array(out, np.float32).reshape(len(out), PATH), place


def path_vectors(page: list[Block]) -> np.ndarray:
    each, place = distinct_paths(page)
    return each[place]


def measures(page: list[Block], words: bool = True, first: int = 0, total: int | None = None) -> np.ndarray:
    """Hashed words (unless without) and a few measures of each block; the blocks from ``first`` on of a page of ``total``."""
    total = len(page) if total is None else total
    out = np.zeros((len(page), WORD + MEASURES), np.float32)
    for k, b in enumerate(page):
        places = np.fromiter(map(zlib.crc32, b.text.lower().encode("utf-8", "surrogatepass").split()), np.uint32)
        if words:
            counts = np.bincount(places % WORD, minlength=WORD)
            out[k, :WORD] = counts / (2 * math.sqrt(counts @ counts))
        n = len(b.text)
        out[k, WORD:] = (
            min(1.0, math.log1p(n) / 8), min(1.0, b.linked / n), min(1.0, len(places) / 50), b.text[-1] in ".!?…\"'”»",
            bool(b.node and b.node.heading), (first + k) / max(1, total - 1),
        )
    return out


def vectors(page: list[Block], words: bool = True) -> np.ndarray:
    return np.concatenate([path_vectors(page), measures(page, words)], axis=1)


# --- model ----------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Labeller:
    """Two LSTMs, forward and backward, and a logistic output for each block."""

    def __init__(self, rng: np.random.Generator, words: bool = True):
        self.p, self.words = {}, words
        for d in "fb":
            self.p[f"w{d}"] = (rng.standard_normal((WIDTH + HIDDEN, 4 * HIDDEN)) / np.sqrt(WIDTH + HIDDEN)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{d}"][:HIDDEN] = 1  # forget little at first
        self.p["wo"] = (rng.standard_normal((2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.p["bo"] = np.zeros(1, np.float32)
        self.training = True

    def run(self, own: np.ndarray, mask: np.ndarray, d: str, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """own: time x pages x the inputs' part of the gates; padding (mask 0) leaves the state as it is. ``state`` is what an earlier step left, and gets what this one leaves."""
        t, n, _ = own.shape
        w, (h, c) = self.p[f"w{d}"][WIDTH:], state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, kept = np.zeros((t, n, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = own[k] + h @ w
            gates = sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if self.training:
                kept.append((k, h, c, f, i, o, g, th, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[k] = h
        if state is not None:
            state[:] = h, c
        return out, kept

    def forward(self, own: dict[str, np.ndarray], mask: np.ndarray):
        a, ka = self.run(own["f"], mask, "f")
        b, kb = self.run(own["b"], mask, "b")
        both = np.concatenate([a, b], axis=2)
        return sigmoid(both @ self.p["wo"] + self.p["bo"])[:, :, 0], both, ka, kb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        own = {d: (x.reshape(-1, WIDTH) @ self.p[f"w{d}"][:WIDTH] + self.p[f"b{d}"]).reshape(*mask.shape, -1) for d in "fb"}
        prob, both, ka, kb = self.forward(own, mask)
        dz = ((prob - y) * mask / max(mask.sum(), 1))[:, :, None]
        g = {"wo": np.einsum("tnh,tno->ho", both, dz), "bo": dz.sum((0, 1))}
        dboth = dz @ self.p["wo"].T
        for d, kept, dout in (("f", ka, dboth[:, :, :HIDDEN]), ("b", kb, dboth[:, :, HIDDEN:])):
            w = self.p[f"w{d}"]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{d}"])
            dh, dc = np.zeros_like(kept[0][1]), np.zeros_like(kept[0][1])
            for k, h, c, f, i, o, gg, th, m in reversed(kept):
                dh = dh + dout[k]
                dh2, dc2 = dh * m, dc * m
                dc2 = dc2 + dh2 * o * (1 - th**2)
                dgate = np.concatenate([dc2 * c * f * (1 - f), dc2 * gg * i * (1 - i), dh2 * th * o * (1 - o), dc2 * i * (1 - gg**2)], axis=1)
                gw[:WIDTH] += x[k].T @ dgate
                gw[WIDTH:] += h.T @ dgate
                gb += dgate.sum(0)
                dh = dgate @ w[WIDTH:].T + dh * (1 - m)
                dc = dc2 * f + dc * (1 - m)
            g[f"w{d}"], g[f"b{d}"] = gw, gb
        return g

    def gates(self, page: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
        """The blocks' part of both directions' gates."""
        w = np.concatenate([self.p["wf"][:WIDTH], self.p["wb"][:WIDTH]], axis=1)
        paths, place = distinct_paths(page)
        return (paths @ w[:PATH])[place] + measures(page, self.words, first, total) @ w[PATH:] + np.r_[self.p["bf"], self.p["bb"]]

    def label_long(self, page: list[Block]) -> np.ndarray:
        """Chances of one page's blocks in steps of AT_ONCE, forward and then backward; a step's gates are computed for each direction."""
        steps = [(at, page[at : at + AT_ONCE]) for at in range(0, len(page), AT_ONCE)]
        ahead, out = np.zeros((len(page), HIDDEN), np.float32), np.zeros(len(page), np.float32)
        for d in "fb":
            state = [np.zeros((1, HIDDEN), np.float32) for _ in range(2)]
            for at, some in steps if d == "f" else reversed(steps):
                own = self.gates(some, at, len(page))[:, None]
                got = self.run(own[..., : 4 * HIDDEN] if d == "f" else own[..., 4 * HIDDEN :], np.ones((len(some), 1), np.float32), d, state)[0][:, 0]
                if d == "f":
                    ahead[at : at + len(some)] = got
                else:
                    both = np.concatenate([ahead[at : at + len(some)], got], axis=1)
                    out[at : at + len(some)] = sigmoid(both @ self.p["wo"] + self.p["bo"])[:, 0]
        return out

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Chances of each block of each page, pages of like length together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            if longest > AT_ONCE:
                k = order.pop()
                out[k] = self.label_long(pages[k])
                continue
            some = order[-max(1, AT_ONCE // longest) :]
            del order[-len(some) :]
            own, mask = np.zeros((longest, len(some), 8 * HIDDEN), np.float32), np.zeros((longest, len(some)), np.float32)
            for j, k in enumerate(some):
                own[: len(pages[k]), j], mask[: len(pages[k]), j] = self.gates(pages[k]), 1
            prob = self.forward({"f": own[:, :, : 4 * HIDDEN], "b": own[:, :, 4 * HIDDEN :]}, mask)[0]
            for j, k in enumerate(some):
                out[k] = prob[: len(pages[k]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


# --- training -------------------------------------------------------------------------------------------------

#: Names under which sites keep what isn't the article, and the article itself.
AROUND = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links toc pagination pager tabs skip",
    "header": "header masthead banner top site branding logo topbar",
    "footer": "footer bottom copyright legal colophon foot credits",
    "aside": "sidebar aside related widget rail recommended trending popular also read more tags secondary complementary",
    "notice": "cookie notice consent gdpr alert paywall modal popup subscribe newsletter disclaimer message warning privacy",
    "ad": "ad ads advert advertisement sponsor sponsored promo adslot banner affiliate teaser",
    "form": "form search login signup contact poll survey",
    "comments": "comments comment replies discussion disqus reply respond responses thread",
    "share": "share social follow sharing byline meta toolbar actions",
}
#: What such parts often say, in four languages.
SAID = {
    "nav": "Home|About us|Contact|News|Products|Next page|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Quiénes somos|Menu|Skip to content",
    "header": "Welcome|Log in|My account|Search|Anmelden|Willkommen|Connexion|Bienvenue|Iniciar sesión|Bienvenido",
    "footer": "Copyright|All rights reserved|Terms of use|Privacy policy|Imprint|Impressum|Datenschutz|Alle Rechte vorbehalten|Tous droits réservés|Mentions légales|Todos los derechos reservados|Aviso legal|Powered by",
    "aside": "Related articles|Read more|Most popular|You may also like|Recent posts|Tags|Mehr lesen|Beliebt|Lire aussi|Articles récents|Leer más|Artículos relacionados",
    "notice": "We use cookies to improve this site|Accept all cookies|Subscribe to our newsletter|Wir verwenden Cookies|Alle akzeptieren|Nous utilisons des cookies|Accepter|Usamos cookies|Aceptar|Your browser is not supported",
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Anzeige|Jetzt kaufen|Publicité|Achetez maintenant|Publicidad|Compra ahora|Free shipping",
    "form": "Enter your email|Your name|Sign up|Send message|Search this site|Ihre E-Mail|Absenden|Votre adresse|Envoyer|Tu correo|Enviar",
    "comments": "Comments|Leave a reply|Log in to comment|Reply|says|Kommentare|Antworten|sagt|Commentaires|Répondre|Comentarios|Responder|great post thanks for sharing|I agree with you",
    "share": "Share this|Tweet|Follow us|Print|Posted by|Teilen|Folgen|Partager|Suivez-nous|Compartir|Síguenos|minutes read",
}
INSIDE = "article content post entry story main body text page wrap container column primary hentry single prose".split()


def training_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and the labels of its blocks, in order. Article blocks begin with a mark that the caller takes away."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "ü", "ß", "ñ", "ç", "sch", "ung", "ción"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    marks = pick(["", "", "", " &amp;", "###", "%%%", "!!", " |"])
    speaks, part = rng.random() < 0.7, ""  # whether the site says the usual things; the part being written
    mute = rng.random() < 0.2  # a site whose elements have no telling names
    plain = mute or rng.random() < 0.25  # one without elements for parts of a page

    def sentence(n: int) -> str:
        if speaks and rng.random() < (0.5 if part else 0.02):
            return pick(SAID[part or pick(list(SAID))].split("|"))
        words = [word() + (marks if marks and rng.random() < 0.4 else "") for _ in range(max(1, n))]
        return " ".join(words).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def prose(short: bool = False) -> str:
        return " ".join(sentence(int(rng.integers(1, 14))) for _ in range(1 if short else int(rng.integers(1, 9))))

    def named(kind: str) -> str:
        if mute:
            return pick(["", f' class="{word()}"', f" class='{word()} {word()}'", f' id="{word()}-{word()}"'])
        said = pick(AROUND[kind].split())
        return pick([f' class="{said}"', f" class='{said} {word()}'", f' id="{said}"', f' class="{pick(["c", "js", "l", "block", "site"])}-{said}"', f' class="{said}-{pick(["box", "wrap", "inner", "list", "area"])}" id={word()}'])

    own_tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}

    def around(kind: str) -> str:
        nonlocal part
        outside, part = part, kind
        text = around_as(kind)
        part = outside
        return text

    def around_as(kind: str) -> str:
        if kind in own_tag and not plain and rng.random() < 0.6:
            tag, attributes = own_tag[kind], pick(["", "", named(kind)])
        else:
            tag, attributes = pick(["div", "div", "div", "section", "ul" if kind == "nav" else "div"]), named(kind)
        links = lambda n: "".join(f'<li><a href="/{word()}">{sentence(int(rng.integers(1, 3))).rstrip(".!?")}</a></li>' for _ in range(n))
        n = int(rng.integers(1, 9))
        if kind == "nav":
            inner = links(n) if tag == "ul" else pick([f"<ul>{links(n)}</ul>", " ".join(f'<a href="#">{word()}</a>' for _ in range(n)), f"<ol>{links(n)}</ol>"])
        elif kind in ("ad", "notice"):
            inner = pick([prose(), f"<p>{prose()}</p>", f'<a href="/x">{prose(True)}</a>', f"<p>{prose(True)}</p><button>{word()}</button>"])
        elif kind == "footer":
            inner = pick([f"&copy; {word()}.example.com &middot; {prose()}", f"<p>&copy; 2024 {prose()}</p>", f"<ul>{links(n)}</ul><p>{prose(True)}</p>"])
        elif kind == "header":
            inner = pick([f"<div>{sentence(2)}</div>", f"<h1>{sentence(2)}</h1>", f'<a href="/">{word()}</a><p>{sentence(3)}</p>'])
        elif kind == "aside":
            inner = pick([f"<h3>{sentence(2)}</h3><ul>{links(n)}</ul>", f"<h2>{sentence(2)}</h2><p>{prose()}</p>", f"<p>{prose()}</p>" * int(rng.integers(1, 3))])
        elif kind == "form":
            inner = f"<p>{sentence(4)}</p><label>{word()}</label><input name=q><select><option>{word()}</select>"
        elif kind == "comments":
            one = lambda: pick([f"<li><b>{word()}</b><p>{prose()}</p></li>", f'<div class="{pick(["comment", "reply", "comment-body"])}"><p>{prose()}</p></div>', f"<p>{prose()}</p>"])
            inner = f"<h3>{sentence(2)}</h3>" * (rng.random() < 0.5) + "".join(one() for _ in range(n))
        else:
            inner = pick([f'<span>{word()}</span> <a href="#">{word()}</a>', f"<p>{sentence(3)}</p>"])
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def article() -> str:
        m = "\x01"
        out = [f"<h1>{m}{sentence(int(rng.integers(2, 12)))}</h1>"] if rng.random() < 0.85 else []
        if out and rng.random() < 0.15:
            out.append(around("share"))
        for _ in range(int(rng.integers(1, 5)) if rng.random() < 0.4 else int(rng.integers(1, 22))):
            r = rng.random()
            if r < 0.68:
                out.append(f"<p>{m}{prose(rng.random() < 0.4)}</p>")
            elif r < 0.76:
                out.append(f"<p><b>{m}{prose()}<br>")
            elif r < 0.82:
                out.append(f"<{pick(['h2', 'h3'])}>{m}{sentence(3)}")
                out[-1] += f"</{out[-1][1:3]}>"
            elif r < 0.87:
                out.append("<ul>" + "".join(f"<li>{m}{prose(True)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif r < 0.91:
                out.append(f"<blockquote>{m}{prose()}</blockquote>")
            elif r < 0.94:
                out.append(f'<p>{m}{prose()} <a href="/y">{word()}</a> {prose(True)}</p>')
            elif r < 0.96:
                out.append(f"<pre>{m}{prose()}</pre>")
            else:
                out.append(around(pick(["ad", "aside", "notice", "share", "form"])))
        if mute:
            return f"<div{named('')}>{''.join(out)}</div>"
        tag = pick(["div", "div", "section"] if plain else ["article", "article", "main", "div", "section"])
        attributes = pick(["", f' class="{pick(INSIDE)}"']) if tag in ("article", "main") else f' {pick(["class", "id"])}="{pick(INSIDE)}{pick(["", "-body", "-content", "-text"])}"'
        return f"<{tag}{attributes}>{''.join(out)}</{tag}>"

    before = [around(k) for k in ("header", "nav", "notice", "ad", "form", "share", "aside") if rng.random() < (0.6 if k == "nav" else 0.3)]
    after = [around(k) for k in ("share", "ad", "aside", "comments", "form", "notice", "nav", "footer") if rng.random() < (0.75 if k == "footer" else 0.3)]
    if rng.random() < 0.3:
        rng.shuffle(before)
        rng.shuffle(after)
    middle = article()
    if rng.random() < 0.3:
        middle = f'<div{pick(["", named("share"), ""])}>{middle}{around("aside")}</div>' if rng.random() < 0.5 else f'<div class="{word() if mute else pick(INSIDE)}">{middle}</div>'
    page = "".join([*before, middle, *after])
    if rng.random() < 0.2:  # in the cells of a table, or one container more
        cell = pick([("<table><tr><td>", "</td></tr><tr><td>", "</td></tr></table>"), ("<table><tr><td>", "</td><td>", "</td></tr></table>"), ("<div><div>", "</div><div>", "</div></div>")])
        page = cell[0] + "".join(before) + cell[1] + middle + cell[1] + "".join(after) + cell[2]
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{page}" + "</body></html>" * (rng.random() < 0.8), []


def example(rng: np.random.Generator, words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(training_page(rng)[0])
    y = np.array(["\x01" in b.text for b in found], np.float32)
    for b in found:
        b.text = b.text.replace("\x01", "").strip() or "."
    return vectors(found, words), y


@lru_cache(2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, words: bool = True) -> Labeller:
    """The model of a bounded number of generated pages; without ``words`` for comparison."""
    rng = np.random.default_rng(seed)
    data = [example(rng, words) for _ in range(pages)]
    data = [d for d in data if len(d[0])]
    model = Labeller(rng, words)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][0]) // 8)
        batches = [order[k : k + 24] for k in range(0, len(order), 24)]
        for b in rng.permutation(len(batches)):
            x, mask = padded([data[k][0] for k in batches[b]])
            y = np.zeros_like(mask)
            for j, k in enumerate(batches[b]):
                y[: len(data[k][1]), j] = data[k][1]
            step += 1
            rate = 0.012 * (1 - epoch / epochs) ** 0.5
            for name, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    model.training = False
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    chances = model.label(found)
    return ["\n".join(b.text for b, c in zip(bs, cs, strict=True) if c > 0.5) for bs, cs in zip(found, chances, strict=True)]


def extract(df: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = np.cumsum(np.r_[0, pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)]), 0
            while at < batch.num_rows:
                n = min(256, max(1, int(np.searchsorted(size, size[at] + PARSED, "right")) - 1 - at))
                part = batch.slice(at, n)
                texts = main_texts(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])
                at += n

    pages = df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
