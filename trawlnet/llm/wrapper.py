"""HTML main-text extraction by wrapper induction (operator 4).

A lenient parser turns a page into a tree of block elements with runs of inline text. Blocks of one label (tag, with its
class or id) under one parent are one slot of the page's shape, as repeated items of a list are. Shapes of pages of a host
are aligned by simple tree matching and merged into the host's template, whose slots keep how many pages have them, how
much text and link text they hold, and by text how many pages hold it there, and how often each of them does. From that
follows what is content:

* A block whose text is there, as often, on a share ``PRESENT`` of a host's pages is template, wherever it stands among
  its siblings. Copies of a page prove nothing: ``DISTINCT`` different pages are needed, and half of a sample of them must
  hold the text.
* The slots that hold the host's varying text lead to the content. From the root down, a plain container (``_GENERIC``)
  is entered if its slot holds, on an average page of the host, ``RICH`` of what the richest slot beside it does; poorer
  containers (menus, adverts, footers, notices) go, but for first headings. Where text stands outside containers, all
  that lies there is content. Containers of one label are told apart by their places, where ``PRESENT`` of the pages have
  the same number of them, and ``PLACES`` different pages do. So a page whose article is shorter than its adverts is cut as the other pages are.
* Outside a marked main part, lists and containers most of whose text is links are menus.
* Tags, roles, ids and classes (``Marks``) are evidence: a part named as no content weighs ``PART_WEIGHT``, an article or
  main part ``MAIN_WEIGHT``, on the way down. Named parts within the content go.

A slot that the template lacks is judged by the page's own numbers, and so is a host's only page. Merging is associative
over statistics of bounded size: tasks merge the pages of their partition, then templates of ``FAN`` partitions at a time
are merged, so no task ever gets all pages of a host. Counts are those of lossy counting: what fewer than a share
``ERROR`` of pages have may be forgotten, and what remains is counted at most that share too low, so a text on ``PRESENT``
of the pages is always found, one on less than ``PRESENT - ERROR`` never, and hosts of less than 1 / ``ERROR`` pages are
counted exactly. Pages are not shuffled: the templates, less the texts that are not constant, are joined to them, by
broadcast while they are at most ``BROADCAST_BYTES`` in all, otherwise by a join in which each host is spread over
``SALTS`` keys.

Defined results: null and empty html give an empty text; unterminated tags at the end are dropped, unterminated
elements end with the page; beyond ``DEPTH`` open blocks further ones are runs of text of the enclosing one; a null
URL's host is empty; equal slots are taken in page order; repeated rows each give a row; other columns of the input are
ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.plans.arrow import map_columns, pieces
from trawlnet.plans.shared import materialise

#: Different pages of a host before its constant texts count as template; share of its pages that must have the text: all, where they are few.
DISTINCT, PRESENT = 2, 0.9
#: Least page hashes that are kept to tell copies of a page from different pages; at least ``DISTINCT``.
SAMPLE = 16
#: Share of a host's pages by which a count may be too low.
ERROR = 0.02
#: Partitions whose templates are merged at once; shapes, and pages of one, between a task's prunings.
FAN, FOLD = 32, 64
#: Share of the richest slot's text that another container beside it needs; share of link text that makes a menu.
RICH, MENU = 0.2, 0.8
#: Different pages that show by their number of equal containers that these are no list; more than ``MOST_PLACES`` always are one.
PLACES, MOST_PLACES = 5, 32
#: Weights of text in parts that are marked as no content, and as the main part.
PART_WEIGHT, MAIN_WEIGHT = 0.05, 10.0
BROADCAST_BYTES, SALTS = 16 << 20, 32
#: Open blocks beyond which further ones only end runs of text and share the enclosing node, but for the first main part there.
DEPTH = 200

# fixed values: elements by kind
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_GENERIC = frozenset("# html body div section article main center form fieldset header footer nav aside menu dialog details".split())
_LISTS = _GENERIC | frozenset("ul ol dl dir table".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCKS - frozenset("option optgroup legend caption summary head html body tbody td tfoot th thead tr".split())
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "p": ("p",)}


@dataclass(frozen=True)
class Marks:
    """What tags, roles, classes and ids say: ``parts`` are no content, ``soft`` ones are none outside a main part. A
    class or id names a part if it is made of ``names`` and ``plain`` words only, and of one of ``names`` at least."""

    main: frozenset[str] = frozenset()
    parts: frozenset[str] = frozenset()
    soft: frozenset[str] = frozenset()
    roles: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    plain: frozenset[str] = frozenset()

    def of(self, name: str, attrs: str) -> tuple[str, int, bool]:
        """The element's own label, whether it is a part (2) or one outside main parts only (1), whether it is main."""
        part, main = 2 if name in self.parts else int(name in self.soft), name in self.main
        first = own = ""
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key == "role":
                    part, main = 2 if value in self.roles else part, main or bool(self.main) and value in ("main", "article")
                elif key == "hidden":
                    part = 2
                elif key in ("class", "id"):
                    found = value.split()
                    if found and key == "class":
                        first = "." + found[0]
                    elif found:
                        own = "#" + found[0]
                    if any(map(self._named, found)):
                        part = 2
        if name in ("html", "body") or part == 1 and main:
            part = 0
        return name + _DIGITS.sub("", first or own), part, main and part < 2

    def _named(self, value: str) -> bool:
        words = [w for w in _SPLIT.split(value) if w]
        return not self.names.isdisjoint(words) and all(w in self.names or w in self.plain for w in words)


# fixed values: names of parts that are no content
MARKS = Marks(
    frozenset(("article", "main")),
    frozenset("button datalist dialog footer form head input label menu nav select".split()),
    frozenset(("aside", "header")),
    frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()),
    frozenset(
        "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
        "footer masthead cookie cookies consent gdpr notice notices alert comment comments disqus reply replies share sharing social related "
        "recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar skip".split()
    ),
    frozenset("area bar bottom box container content global group inner left links list main outer page right section site top widget wrap wrapper".split()),
)
#: No evidence but the pages themselves.
NO_MARKS = Marks()

_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|template|select|svg|object|audio|video)\b{_ATTRS}(?:>.*?(?:</(?P=raw)\s*(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})(?P<close>>|\Z)|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?P<close2>>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'>/=][^\s"'>/=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]{2,}")


class Block:
    """A block element; strings in ``kids`` are its runs of text, ``links`` counts the characters of links in them."""

    __slots__ = ("label", "tag", "kids", "part", "main", "text", "depth", "in_main", "links", "chars")

    def __init__(self, label: str, tag: str, part: bool = False, main: bool = False, above: Block | None = None):
        self.label, self.tag, self.part, self.main = label, tag, part, main
        self.depth, self.in_main = (above.depth + 1, main or above.in_main) if above else (0, main)
        self.kids: list = []
        self.text: int | None = None
        self.links = self.chars = 0


def parse(html: str, marks: Marks = MARKS) -> Block:
    """The tree of blocks; inline text is a string in ``kids``, with white space as single spaces."""
    root = Block("#", "#")
    # name, block (of an inline element: None; beyond DEPTH: the enclosing one), whether its text is hidden
    stack: list[tuple[str, Block | None, bool]] = [("#", root, False)]
    places: dict[str, list[int]] = {}  # of the open elements of a name in the stack
    blocks = [0]  # places of block elements
    block, hidden, run, linked = root, 0, [], 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                block.kids.append(text)
                block.links += min(linked, len(text))
            run.clear()
        linked = 0

    def push(name: str, own: Block | None, hid: bool) -> None:
        nonlocal hidden
        places.setdefault(name, []).append(len(stack))
        if own:
            blocks.append(len(stack))
        stack.append((name, own, hid))
        hidden += hid

    def pop_to(k: int) -> None:
        nonlocal block, hidden
        if blocks[-1] >= k:
            flush()
        while len(stack) > k:
            name, own, hid = stack.pop()
            places[name].pop()
            if own:
                blocks.pop()
            hidden -= hid
        block = stack[blocks[-1]][1]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and not hidden:
            run.append(html[at : m.start()])
            if places.get("a"):
                linked += len(run[-1].strip())
        at = m.end()
        name = m["name"] or m["name2"]
        if not name or not (m["close"] or m["close2"]):
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            k = places[name][-1] if places.get(name) else 0
            if k and (name in _BLOCKS or k > blocks[-1]):
                pop_to(k)
            continue
        if name == "br":
            if not hidden:
                run.append(" ")
            continue
        label, part, main = marks.of(name, m["attrs"] or m["attrs2"] or "")
        if name not in _BLOCKS:
            if name == "a" and places.get("a") and places["a"][-1] > blocks[-1]:
                pop_to(places["a"][-1])  # links don't nest
            if name not in _VOID:
                push(name, None, part == 2 and name != "input")
            continue
        closes = _SAME.get(name, ())
        if name in _CLOSES_P:
            closes = (*closes, "p")
        if closes:
            at_block = len(blocks) - 1
            while at_block > 0:
                k = blocks[at_block]
                if stack[k][0] in closes:
                    pop_to(k)
                    if stack[k - 1][0] not in closes or name == "p":
                        break
                elif not (stack[k][0] == "p" or name == "tr" and stack[k][0] in ("td", "th")):
                    break
                at_block -= 1
        flush()
        if name == "hr":
            continue
        none = part == 2 or part == 1 and not block.in_main
        if block.depth >= DEPTH and (block.in_main or not main or none):
            push(name, block, none)
            continue
        node = Block(label + "!" * none + "*" * main, name, none or bool(hidden), main, block)
        block.kids.append(node)
        push(name, node, False)
        block = node
    if at < len(html) and not hidden:
        run.append(html[at:])
    flush()
    return root


class Slot:
    """A slot of a template: ``pages`` that have it, of which ``error`` more at most are forgotten; characters of text
    outside links and in links, over all of them; ``texts``: by text and how often a page holds it here, [pages,
    forgotten pages at most, the ``SAMPLE`` least hashes of those pages, characters]; ``places``: by the number of
    containers in one parent that are this slot, [pages, characters of each]; ``kids`` in page order."""

    __slots__ = ("label", "pages", "error", "chars", "links", "texts", "places", "kids")

    def __init__(self, label: str, pages: int = 0, error: int = 0, chars: int = 0, links: int = 0, texts: dict | None = None, places: dict | None = None, kids: list | None = None):
        self.label, self.pages, self.error, self.chars, self.links = label, pages, error, chars, links
        self.texts, self.places, self.kids = texts or {}, places or {}, kids or []

    def dump(self) -> list:
        return [self.label, self.pages, self.error, self.chars, self.links, self.texts, self.places, [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, x: list) -> Slot:
        return cls(*x[:7], [cls.load(k) for k in x[7]])

    @property
    def tag(self) -> str:
        return _LABEL.match(self.label)[0]

    @property
    def part(self) -> bool:
        return "!" in self.label

    @property
    def main(self) -> bool:
        return self.label.endswith("*")


_LABEL = re.compile(r"#|[^.#!*]*")


def _key(text: int, times: int) -> str:
    return f"{text:x}.{times}"


def shape_of(root: Block, page: int = 0) -> Slot:
    """The template of one page, whose hash is ``page``. Sets the blocks' ``text``."""

    def count(block: Block) -> int:
        block.chars = -block.links
        for k in block.kids:
            block.chars += len(k) if isinstance(k, str) else 0 if k.part else count(k)
        return block.chars

    def fold(label: str, blocks: list[Block]) -> Slot:
        out = Slot(label, 1)
        counts: dict[int, list[int]] = {}
        kids: dict[str, list[Block]] = {}
        for block in blocks:
            texts = [k for k in block.kids if isinstance(k, str)]
            if texts:
                whole = "\n".join(texts)
                block.text = xxhash.xxh64_intdigest(whole.encode("utf-8", "replace"))
                got = counts.setdefault(block.text, [0, len(whole) - block.links])
                got[0] += 1
                out.chars += len(whole) - block.links
                out.links += block.links
            for k in block.kids:
                if not isinstance(k, str):
                    kids.setdefault(k.label, []).append(k)
        out.texts = {_key(h, n): [1, 0, [page], chars * n] for h, (n, chars) in counts.items()}
        out.kids = [fold(k, v) for k, v in kids.items()]
        for k, v in zip(out.kids, kids.values()):
            if len(blocks) == 1 < len(v) <= MOST_PLACES and k.tag in _GENERIC:
                k.places = {str(len(v)): [1, [b.chars for b in v]]}
        return out

    count(root)
    return fold(root.label, [root])


def skeleton(shape: Slot) -> str:
    """The labels of a shape, as a key of shapes that align alike."""
    return f"{shape.label}({','.join([skeleton(s) for s in shape.kids])})"


def match(a: Slot, b: Slot) -> int:
    """Simple tree matching: nodes of the largest common top-down order-preserving part."""
    return _table(a, b)[-1][-1] + 1 if a.label == b.label else 0


def _table(a: Slot, b: Slot) -> list[list[int]]:
    up = [[0] * (len(b.kids) + 1)]
    for x in a.kids:
        row, last = [0], up[-1]
        for j, y in enumerate(b.kids):
            row.append(max(last[j + 1], row[j], last[j] + match(x, y) if x.label == y.label else 0))
        up.append(row)
    return up


def align(a: Slot, b: Slot) -> list[tuple[int | None, int | None]]:
    """Children of ``a`` and ``b`` in common order; None on the side that has no partner."""
    if [x.label for x in a.kids] == [x.label for x in b.kids]:
        return [(i, i) for i in range(len(a.kids))]
    t, i, j, out = _table(a, b), len(a.kids), len(b.kids), []
    while i or j:
        if i and j and a.kids[i - 1].label == b.kids[j - 1].label and t[i][j] == t[i - 1][j - 1] + match(a.kids[i - 1], b.kids[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and t[i][j] == t[i - 1][j]:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def merge(a: Slot, b: Slot, error_a: int = 0, error_b: int = 0) -> Slot:
    """The template of the pages of both, whose counts may be too low by the errors; the labels of the roots are equal."""
    kids = []
    for i, j in align(a, b):
        if i is None or j is None:
            own, error = (a.kids[i], error_b) if j is None else (b.kids[j], error_a)
            kids.append(Slot(own.label, own.pages, own.error + error, own.chars, own.links, own.texts, own.places, own.kids))
        else:
            kids.append(merge(a.kids[i], b.kids[j], error_a, error_b))
    texts = dict(a.texts) if error_b == 0 else {k: v if k in b.texts else [v[0], v[1] + error_b, *v[2:]] for k, v in a.texts.items()}
    _add_texts(texts, b.texts, error_a)
    places = dict(a.places)
    _add_places(places, b.places)
    return Slot(a.label, a.pages + b.pages, a.error + b.error, a.chars + b.chars, a.links + b.links, texts, places, kids)


def _add_places(to: dict, more: dict) -> None:
    for k, (n, chars) in more.items():
        m, own = to.get(k, (0, [0] * len(chars)))
        to[k] = [m + n, [x + y for x, y in zip(own, chars)]]


def _add_texts(to: dict, more: dict, error: int) -> None:
    """Add the counts of ``more`` to ``to``, whose values are replaced, not changed; what ``to`` lacks it may have forgotten."""
    for k, (n, off, pages, chars) in more.items():
        if k in to:
            m, off_to, own, _ = to[k]
            if own != pages and (len(own) < SAMPLE or pages[0] < own[-1]):
                own = sorted({*own, *pages})[:SAMPLE]
            to[k] = [m + n, off_to + off, own, chars]
        else:
            to[k] = [n, off + error, pages, chars]


def _prune(t: Slot, error: int) -> Slot:
    kids = [_prune(x, error) for x in t.kids if x.pages + x.error > error]
    return Slot(t.label, t.pages, t.error, t.chars, t.links, {k: v for k, v in t.texts.items() if v[0] + v[1] > error}, t.places, kids)


class HostTemplate:
    """Pages, the ``SAMPLE`` least hashes of different pages, by how much counts may be too low, and the template."""

    def __init__(self, pages: int, different: list[int], error: int, tree: Slot):
        self.pages, self.different, self.error, self.tree = pages, different, error, tree

    def add(self, other: HostTemplate) -> None:
        self.tree = merge(self.tree, other.tree, self.error, other.error)
        self.pages += other.pages
        self.error += other.error
        self.different = sorted({*self.different, *other.different})[:SAMPLE]
        self.prune()

    def prune(self) -> None:
        """Forget what at most a share ``ERROR`` of the pages has (lossy counting)."""
        error = int(ERROR * self.pages)
        if error > self.error:
            self.error, self.tree = error, _prune(self.tree, error)

    def dump(self) -> str:
        return json.dumps([self.pages, self.different, self.error, self.tree.dump()], separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> HostTemplate:
        pages, different, error, tree = json.loads(text)
        return cls(pages, different, error, Slot.load(tree))

    def only_constant(self) -> HostTemplate:
        """Without the texts that are not template; their characters leave the slots' counts with them."""
        sample = set(self.different)
        # a full sample only tells copies from different pages; a smaller one is all the different pages
        least = len(sample) * (PRESENT if len(sample) < SAMPLE else 0.5)

        def constant(n: int, off: int, pages: list[int]) -> bool:
            return len(sample) >= DISTINCT and n + off >= PRESENT * self.pages and len(sample.intersection(pages)) >= least

        def keep(t: Slot) -> Slot:
            texts = {k: [n, 0, [], chars] for k, (n, off, pages, chars) in t.texts.items() if constant(n, off, pages)}
            chars = max(0, t.chars - sum(n * size for n, _, _, size in texts.values()))
            places = {k: v for k, v in t.places.items() if len(sample) >= PLACES and v[0] >= PRESENT * t.pages}
            return Slot(t.label, t.pages, t.error, chars, t.links, texts, places, [keep(x) for x in t.kids])

        return HostTemplate(self.pages, self.different, self.error, keep(self.tree))


def _add_counts(a: Slot, b: Slot, error: int) -> None:
    """Add ``b`` to ``a`` in place, both of the same skeleton."""
    a.pages += b.pages
    a.chars += b.chars
    a.links += b.links
    _add_texts(a.texts, b.texts, error)
    _add_places(a.places, b.places)
    for x, y in zip(a.kids, b.kids):
        _add_counts(x, y, error)


def _page_templates(hosts: list[str], htmls: list[str | None], known: dict[str, dict[str, HostTemplate]], marks: Marks = MARKS) -> None:
    for host, page in zip(hosts, htmls):
        digest = xxhash.xxh64_intdigest((page or "").encode("utf-8", "replace"))
        own = shape_of(parse(page or "", marks), digest)
        key = skeleton(own)
        same = known.setdefault(host, {})
        if key in same:
            t = same[key]
            t.pages += 1
            if digest not in t.different:
                t.different = sorted([*t.different, digest])[:SAMPLE]
            _add_counts(t.tree, own, t.error)
            if t.pages % FOLD == 0:
                t.prune()
                if skeleton(t.tree) != key:  # it has forgotten a slot
                    del same[key]
                    _add_total(same, t)
        else:
            if len(same) >= FOLD:
                total = _total(same)
                same.clear()
                same[""] = total
            same[key] = HostTemplate(1, [digest], 0, own)


def _add_total(same: dict[str, HostTemplate], t: HostTemplate) -> None:
    if "" in same:
        same[""].add(t)
    else:
        same[""] = t


def _ordered(templates: list[tuple[str, HostTemplate]]) -> list[HostTemplate]:
    return [t for _, t in sorted(templates, key=lambda x: (-x[1].pages, x[0]))]


def _total(own: dict[str, HostTemplate]) -> HostTemplate:
    first, *others = _ordered(list(own.items()))
    for t in others:
        first.add(t)
    return first


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def host_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", marks: Marks = MARKS) -> DataFrame:
    """host, template (JSON, without texts that are not constant) of every host."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, HostTemplate]] = {}
        for batch in batches:
            for part in pieces(batch):
                _page_templates(part.column(0).to_pylist(), part.column(1).to_pylist(), known, marks)
        yield from _emit({(host, TaskContext.get().partitionId()): list(own.items()) for host, own in known.items()})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[str, int], list[tuple[str, HostTemplate]]] = {}
        for batch in batches:
            for host, part, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got.setdefault((host, part), []).append((text, HostTemplate.load(text)))
        yield from _emit(got)

    schema = "host string, part bigint, template string"
    source = pages.select(_host(F.col(url_col)).alias("host"), html_col)
    out, left = materialise(source.mapInArrow(first, schema), "templates"), None
    while left is None or left > 0:
        out = out.withColumn("part", F.expr(f"part DIV {FAN}")).repartition("host", "part").mapInArrow(again, schema)
        out = materialise(out, "templates")
        left = out.agg(F.max("part")).first()[0] or 0
    constants = lambda hosts, texts: [hosts, [HostTemplate.load(t).only_constant().dump() for t in texts]]
    return map_columns(out.select("host", "template"), "host string, template string", lambda: constants)


def _emit(groups: dict[tuple[str, int], list[tuple[str, HostTemplate]]]) -> Iterator[pa.RecordBatch]:
    rows = [(host, part, _total(dict(own)).dump()) for (host, part), own in groups.items()]
    if rows:
        host, part, text = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(part, pa.int64()), pa.array(text, pa.string())], ["host", "part", "template"])


def _weigh(t: Slot, weights: dict[int, tuple[float, float, float]], in_main: bool = False) -> tuple[float, float, float]:
    """By the identity of each slot under ``t``: weighted text, text and link text on an average page that has the slot."""
    own = in_main or t.main
    below = [(_weigh(k, weights, own), k) for k in t.kids]
    of = lambda i, mine: mine + sum(w[i] * k.pages for w, k in below) / max(1, t.pages)
    chars, links = t.chars / max(1, t.pages), t.links / max(1, t.pages)
    weight = (PART_WEIGHT if t.part else 1.0) * (MAIN_WEIGHT if t.main and not in_main else 1.0)
    weights[id(t)] = of(0, chars) * weight, of(1, chars), of(2, links)
    return weights[id(t)]


class Wrapper:
    """Extraction with a host's template; alignments are kept by skeleton."""

    def __init__(self, template: str | None, marks: Marks = MARKS):
        self._marks = marks
        self._of = HostTemplate.load(template) if template else None
        self._weights: dict[int, tuple[float, float, float]] = {}
        if self._of:
            _weigh(self._of.tree, self._weights)
        self._known: dict[str, dict[tuple[str, ...], Slot]] = {}

    def _aligned(self, shape: Slot) -> dict[tuple[str, ...], Slot]:
        """The template's slots by the path of labels of the page's."""
        if self._of is None:
            return {}
        key = skeleton(shape)
        if key not in self._known:
            if len(self._known) > 5000:
                self._known.clear()
            self._known[key] = {}
            self._walk(self._of.tree, shape, (), self._known[key])
        return self._known[key]

    def _walk(self, t: Slot, own: Slot, path: tuple[str, ...], found: dict) -> None:
        found[path] = t
        for i, j in align(t, own):
            if i is not None and j is not None:
                self._walk(t.kids[i], own.kids[j], (*path, own.kids[j].label), found)

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        root = parse(html, self._marks)
        shape = shape_of(root)
        weights = dict(self._weights)
        _weigh(shape, weights)
        page = _Page(self._aligned(shape), weights)
        page.select(shape, ())
        out: list[str] = []
        page.emit(root, shape, (), out)
        return "\n".join(out)


class _Page:
    """What is content of one page: ``open`` slots hold some, ``whole`` ones are content with all below but parts, menus
    and constant texts; of ``headed`` ones only first headings are."""

    def __init__(self, aligned: dict[tuple[str, ...], Slot], weights: dict[int, tuple[float, float, float]]):
        self._aligned, self._weights = aligned, weights
        self.open: set[tuple] = set()
        self.whole: set[tuple] = set()
        self.headed: set[tuple] = set()
        self.loose: set[tuple] = set()
        self._poor: dict[tuple, list[bool]] = {}
        self._constants: dict[tuple, set[int]] = {}

    def _weight(self, own: Slot, path: tuple) -> tuple[float, float, float]:
        return self._weights[id(self._aligned.get(path, own))]

    def _menu(self, own: Slot, path: tuple) -> bool:
        """Whether a slot is a list or container most of whose text is links."""
        _, chars, links = self._weight(own, path)
        return own.tag in _LISTS and links > 0 and links >= MENU * (chars + links)

    def select(self, own: Slot, path: tuple, in_main: bool = False) -> None:
        in_main = in_main or own.main
        kids = [(k, (*path, k.label)) for k in own.kids]
        if in_main and not any(_has_main(k) for k in own.kids):
            self.whole.add(path)
            return
        chars = self._aligned[path].chars / max(1, self._aligned[path].pages) if path in self._aligned else own.chars
        heavy = [self._weight(k, p)[0] for k, p in kids]
        best = max(heavy, default=0.0)
        lead = own.kids[heavy.index(best)] if best else None
        if lead is None or chars >= best or lead.tag not in _GENERIC:
            self.whole.add(path)
            return
        self.open.add(path)
        marked = _has_main(lead)
        if not marked:
            self.loose.add(path)
        for (k, p), w in zip(kids, heavy):
            if k.tag in _GENERIC and w >= RICH * best:
                self._compare_places(k, p)
                self.select(k, p, in_main)
            elif k.tag not in _GENERIC and not k.part and (not marked or w >= RICH * best) and not self._menu(k, p):
                self.whole.add(p)
            elif k.tag in _GENERIC and not marked and not k.part:
                self.headed.add(p)

    def _compare_places(self, own: Slot, path: tuple) -> None:
        """Mark the poor ones of a page's containers that are one slot, if the host's pages tell them apart by place."""
        t = self._aligned.get(path)
        for n in own.places:
            if t is not None and n in t.places:
                chars = t.places[n][1]
                self._poor[path] = [x < RICH * max(chars) for x in chars]

    def emit(self, block: Block, shape: Slot, path: tuple, out: list[str], state: int = 0, in_main: bool = False) -> None:
        """``state``: 0 outside content, 1 within, 2 where only first headings are. A whole slot without text of its own
        but in links is no menu, for then nothing else is left of it."""
        in_main = in_main or block.main
        if state != 1 and path in self.whole:
            state = 1
        elif state == 0 and path in self.headed:
            state = 2
        elif state == 0 and path not in self.open:
            return
        own = (state == 1 or path in self.loose or state == 2 and block.tag == "h1") and block.text not in self._constant(shape, path)
        below, seen = {k.label: k for k in shape.kids}, dict.fromkeys(self._poor, 0)
        bare = self._weight(shape, path)[1] == 0
        for kid in block.kids:
            if isinstance(kid, str):
                if own:
                    out.append(kid)
                continue
            slot, p = below[kid.label], (*path, kid.label)
            if p in self._poor:
                seen[p] += 1
                if self._poor[p][seen[p] - 1]:
                    continue
            if state and kid.part and p not in self.open:
                continue
            if state == 1 and not in_main and not bare and self._menu(slot, p):
                continue
            self.emit(kid, slot, p, out, state, in_main)

    def _constant(self, shape: Slot, path: tuple) -> set[int]:
        """The texts of a slot that are template."""
        if path not in self._constants:
            t = self._aligned.get(path)
            self._constants[path] = {int(k.partition(".")[0], 16) for k in t.texts if k in shape.texts} if t else set()
        return self._constants[path]


def _has_main(t: Slot) -> bool:
    return not t.part and (t.main or any(map(_has_main, t.kids)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: Marks = MARKS) -> DataFrame:
    """``id_col``, ``url_col``, text of every row."""
    templates = host_templates(pages, url_col, html_col, marks)
    size = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).withColumn("host", _host(F.col("_url")))
    if size <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(templates), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("_id", "_url", F.length("_html")), F.lit(SALTS))
        spread = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = source.withColumn("_salt", salt).join(spread, ["host", "_salt"], "left")
    joined = joined.select("_id", "_url", "_html", "template")

    def setup() -> Callable[..., list]:
        wrappers: dict[str | None, Wrapper] = {}

        def run(keys: list, urls: list, htmls: list, texts: list) -> list:
            out = []
            for page, template in zip(htmls, texts):
                if template not in wrappers:
                    if len(wrappers) > 500:
                        wrappers.clear()
                    wrappers[template] = Wrapper(template, marks)
                out.append(wrappers[template].text(page))
            return [keys, urls, out]

        return run

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return map_columns(joined, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string", setup)


def extract_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
