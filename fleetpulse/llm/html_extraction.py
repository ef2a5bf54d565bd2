"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut at the tags of block elements; each run of text between them is a leaf block with its ancestors. A block's
features are its ancestors' tags, the words (up to seven letters) of their class, id and role attributes, its own tag, how much of it is
link text, its length, how it ends, and what the page says as a whole (has an article or main element, and whether the
block is in it). Unary weights and two-state transitions are trained by maximum likelihood on the labelled pages of
`labelled_pages` (filled in with random words, with other names for the same kinds of element, and some with their attributes taken away), and Viterbi
gives the most likely sequence of main and other blocks.

Text: character references decoded, white space inside a block turned into one space, trimmed, blocks joined by a
newline in page order. Scripts, styles, comments and other elements without visible text are no blocks. Of those, only
elements of raw text and comments run to the end of the page if nothing closes them; other unclosed ones and self-closed
ones are empty. A head has no text of its own: what is not hidden by itself there belongs to the body.

Each page is worked out alone in its task, from the whole html; the model has some hundred weights.

Rows: null or empty html and pages without main text give an empty text; equal rows give equal results; unclosed and
misnested tags are taken as browsers roughly do (a closing tag closes its nearest open match, a block in a paragraph
ends the paragraph); an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetpulse.llm.labelled_pages import KINDS, PAGES
from fleetpulse.llm.tables import arrow_map, columns

# Elements by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"button", "option", "optgroup", "select", "textarea", "body", "html", "legend", "summary"}
SAME = frozenset("li dd dt option tr td th".split())  # a second one ends the first
RAW = "script|style|title|iframe"  # hidden, and nothing in them is a tag
HIDDEN = "template|noscript|svg|object|canvas|audio|video"

_REST = r"""(?=[\s/>])(?:(?:"[^"]*"|'[^']*'|[^'">])*|[^>]*)"""  # of an opening tag, after the name
_UNSEEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW}){_REST}(?:(?<=/)>|>.*?(?:</\1(?=[\s/>])[^>]*>|\Z))|<[!?][^>]*>", re.S | re.I)
_HIDING = re.compile(rf"<(/?)({HIDDEN}){_REST}>", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|keep)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

Block = tuple[str, list[str], bool]  # text, features, marked


def visible(page: str) -> str:
    """The page without its hidden parts, a space for each."""
    page = _UNSEEN.sub(" ", page)
    parts: list[tuple[int, int]] = []  # from the first to the last character of a closed element or a lone tag
    opened: list[tuple[str, int]] = []
    count = dict.fromkeys(HIDDEN.split("|"), 0)
    for tag in _HIDING.finditer(page):
        name, start = tag[2].lower(), tag.start()
        if tag[1] and count[name]:
            last = ""
            while last != name:
                last, start = opened.pop()
                count[last] -= 1
        elif not tag[1] and page[tag.end() - 2] != "/":
            opened.append((name, start))
            count[name] += 1
        while parts and parts[-1][0] >= start:
            parts.pop()
        parts.append((start, tag.end()))
    out, at = [], 0
    for start, end in parts:
        out += [page[at:start], " "]
        at = end
    return "".join(out) + page[at:]


def leaf_blocks(page: str, bare: bool = False) -> list[Block]:
    """The page's leaf blocks in order. `bare` leaves attributes out of the features."""
    page = visible(page)
    stack: list[tuple[str, list[str], bool]] = []
    out: list[tuple[str, int, list[tuple[str, list[str], bool]]]] = []
    texts: list[str] = []
    linked, links, at = 0, 0, 0

    def end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(texts))).strip()
        if text:
            out.append((text, linked, stack.copy()))
        texts.clear()
        linked = 0

    def close(place: int) -> None:
        nonlocal links
        if any(x[0] in BLOCKS for x in stack[place:]):
            end()
        links -= sum(x[0] == "a" for x in stack[place:])
        del stack[place:]

    for tag in _TAG.finditer(page):
        if tag.start() > at:
            texts.append(page[at : tag.start()])
            if links:
                linked += tag.start() - at
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if place >= 0:
                close(place)
            elif name in BLOCKS:
                end()
            continue
        if name == "br":
            texts.append(" ")
            continue
        if name in BLOCKS:
            if name in CLOSES_P or name in SAME:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" and name in CLOSES_P or stack[i][0] == name and name in SAME:
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            end()
        if name in VOID or name == "head" or tag[3].endswith("/"):
            continue
        names, kept = [], False
        for attribute in _ATTRIBUTE.finditer(tag[3]) if tag[3] else ():
            if attribute[1].lower() == "keep":
                kept = True
            elif not bare:
                names += _NAME.findall((attribute[2] or "").lower())
        stack.append((name, names, kept))
        links += name == "a"
    texts.append(page[at:])
    end()
    whole = {x[0] for _, _, path in out for x in path} & {"article", "main"}
    return [(text, _features(text, linked, path, whole), any(x[2] for x in path)) for text, linked, path in out]


def _features(text: str, linked: int, path: list[tuple[str, list[str], bool]], whole: set[str]) -> list[str]:
    tags = {x[0] for x in path}
    words = text.count(" ") + 1
    share = linked / max(1, len(text))
    length = next(f"w{k}" for k in (2, 6, 15, 40, 10**12) if words <= k)
    end = "stop" if text[-1] in ".!?…:\"'»”" else "open"
    found = [f"in {t}" for t in tags] + [f"of {n[:7]}" for x in path for n in x[1]]
    found += [f"own {next((x[0] for x in reversed(path) if x[0] in BLOCKS), '')}", length, end, f"{length} {end}"]
    found += ["all link" if share > 0.7 else "some link" if share > 0.2 else "no link", "bias"]
    found += [f"{'inside' if tag in tags else 'outside'} {tag}" for tag in whole]
    return list(dict.fromkeys(found))


def _training() -> list[list[Block]]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(("ra", "ne", "to", "li", "mus", "der", "on")) for _ in range(rng.randint(1, 3)))
    some = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    fill = {"p": lambda: some(18, 90) + ".", "s": lambda: some(5, 14) + rng.choice((".", "", "!")), "w": lambda: some(1, 4)}
    kinds = [kind.split() for kind in KINDS]

    def renamed(attribute: re.Match) -> str:
        kind = next((k for k in kinds if set(_NAME.findall(attribute[2])) & set(k)), None)
        return f'{attribute[1]}="{rng.choice(kind)}"' if kind and rng.random() < 0.8 else attribute[0]

    out = []
    for turn in range(40):
        for page in PAGES:
            text = re.sub(r'(class|id|role)="([^"]*)"', renamed, page)
            text = re.sub(r"\{([psw])\}", lambda m: fill[m[1]](), text)
            out.append(leaf_blocks(text, bare=turn % 4 == 3))
    return out


def train() -> tuple[dict[str, tuple[float, float]], np.ndarray]:
    """Unary weights of each feature for (other, main) and log-weights of transitions."""
    pages = _training()
    names = sorted({f for page in pages for _, features, _ in page for f in features})
    place = {f: i for i, f in enumerate(names)}
    longest = max(map(len, pages))
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for i, page in enumerate(pages):
        for j, (_, features, marked) in enumerate(page):
            x[i, j, [place[f] for f in features]] = 1
            y[i, j], real[i, j] = marked, True
    flat = x.reshape(-1, len(names))
    weight, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    truth = np.eye(2)[y] * real[..., None]
    pairs = real[:, 1:] & real[:, :-1]
    true_moves = np.einsum("ij,ija,ijb->ab", pairs, truth[:, :-1], truth[:, 1:])
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, 201):
        unary = (flat @ weight).reshape(len(pages), longest, 2) * real[..., None]
        forward, back = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for j in range(1, longest):
            sums = np.logaddexp.reduce(forward[:, j - 1, :, None] + moves, axis=1) + unary[:, j]
            forward[:, j] = np.where(real[:, j, None], sums, forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            sums = np.logaddexp.reduce(moves + (unary[:, j + 1] + back[:, j + 1])[:, None, :], axis=2)
            back[:, j] = np.where(real[:, j + 1, None], sums, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
        single = np.exp(forward + back - total) * real[..., None]
        double = np.exp(forward[:, :-1, :, None] + moves + (unary[:, 1:] + back[:, 1:])[:, :, None, :] - total[..., None]) * pairs[..., None, None]
        slopes = [flat.T @ (single - truth).reshape(-1, 2) / len(pages) + 0.001 * weight, (double.sum(axis=(0, 1)) - true_moves) / len(pages) + 0.01 * moves]
        for k, (target, slope) in enumerate(zip((weight, moves), slopes)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * slope
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * slope**2
            target -= 0.1 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return {f: (float(weight[i, 0]), float(weight[i, 1])) for f, i in place.items()}, moves


def viterbi(blocks: list[Block], weights: dict[str, tuple[float, float]], moves: np.ndarray) -> list[bool]:
    """Whether each block is main text in the most likely sequence."""
    (oo, om), (mo, mm) = moves.tolist()
    back: list[tuple[bool, bool]] = []
    other = main = 0.0
    for i, (_, features, _) in enumerate(blocks):
        known = [weights[f] for f in features if f in weights]
        o, m = sum(w[0] for w in known), sum(w[1] for w in known)
        if i:
            back.append((main + mo > other + oo, main + mm > other + om))
            o, m = o + max(main + mo, other + oo), m + max(main + mm, other + om)
        other, main = o, m
    out = [main > other]
    for from_other, from_main in reversed(back):
        out.append(from_main if out[-1] else from_other)
    return out[::-1]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(train())

    def main_text(page: str | None) -> str:
        blocks = leaf_blocks(page) if page else []
        return "\n".join(b[0] for b, keep in zip(blocks, viterbi(blocks, *sent.value)) if keep) if blocks else ""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [main_text(page.as_py()) for page in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return arrow_map(columns(pages, page_id="long", url="string", html="string"), work, "page_id long, url string, text string, n_chars long")
