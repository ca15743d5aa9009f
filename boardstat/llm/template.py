"""Main text of web pages by equivalence classes of tokens over the pages of a host.

Tokens are the elements of a page, told apart by their path, and its text nodes. Tokens of a host that occur equally
often on each of its pages form an equivalence class. Classes of enough pages and tokens, whose elements stand inside
elements of the same or another such class, nest into the host's template; the places it leaves open are slots. The
slot that holds the article is chosen from the template, and what each page has there is its main text.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from hashlib import blake2b

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardstat.frames import materialize
from boardstat.functions.markup import START, TEXT, events

from .shared import small_batches, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A class belongs to the template if its tokens are on this part of the host's pages, on two pages at least, and it has
#: this many tokens. Texts of the slot need this many pages that differ in their other text.
SUPPORT = 0.5
CLASS_TOKENS = 3
WITNESSES = 3
#: In a slot marked as an article, a text is the template's only if this part of the text of its element is the template's.
OWN = 0.8
#: Paths are written out to this depth; elements below it share a path with a hash of what follows.
DEPTH = 64
# Element names and class words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i iframe img input ins kbd label map mark "
                   "math meter object output picture progress q rp rt ruby s samp select small source span strike strong sub "
                   "sup svg textarea time tt u var wbr br".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object select textarea button".split())
BESIDES = frozenset("nav header footer aside form menu dialog".split())
#: Roles of elements beside an article, written into a path like a class.
ROLES = frozenset("navigation complementary banner contentinfo search dialog alert".split())
#: Class words and ids of parts beside an article; a class of several parts needs each part among these or PARTS.
NAMED = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
                  "commentlist comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter "
                  "notice notices popup promo promos promotion related replies respond share sharing sidebar signup social "
                  "sponsor sponsored sponsors subscribe subscription".split())
PARTS = frozenset("area bar block box button buttons bottom center container form icons inner item items left links list "
                  "outer overlay panel posts right section site slot thread top unit widget wrap wrapper".split())
COMMENTS = frozenset("comment commentlist comments disqus replies respond".split())
MAIN_NAMED = re.compile(r"(^|[-_.#])(article|content|post|entry|story|main)([-_.#]|$|-?body|-?text)")
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
         "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}


def _short(name: str, size: int = 100) -> str:
    return name if len(name) <= size else f"{name[:size]}~{blake2b(name.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


class Page:
    """Elements and text nodes of one page in order: `elements` holds paths, `texts` (path, text, block number).

    Any string is a page, and the time to read it grows with its length: open elements are found by tag, and a path is
    no longer than DEPTH elements and a hash of what lies below them.
    """

    def __init__(self, html: str):
        self.stack: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
        self.elements: list[str] = []
        self.texts: list[tuple[str, str, int]] = []
        self.block = 0
        for event in events(html):
            if event[0] == TEXT:
                self.texts.append((self.stack[-1][1] if self.stack else "", event[1], self.block))
            elif event[0] == START:
                self._start(event[1], event[2])
            elif self.places[event[1]]:
                self._close_to(self.places[event[1]][-1])

    def _close_to(self, depth: int) -> None:
        ended = False
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            ended = ended or tag not in INLINE
        self.block += ended

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def _start(self, tag: str, attributes: dict) -> None:
        if tag in _CLOSES_P and self.places["p"]:
            self._close_to(self.places["p"][-1])
        elif tag in _SAME:
            same, around = _SAME[tag]
            depth = self._last(same)
            if depth > self._last(around - {tag}):
                self._close_to(depth)
        name = tag + "".join("." + c for c in sorted(attributes.get("class", "").lower().split()))
        name += "#" + attributes["id"].lower().strip() if attributes.get("id") else ""
        role = attributes.get("role", "").lower()
        name += ".main" if role == "main" else f".@{role}" if role in ROLES else ""
        path = self._below(_short(name.replace("/", "_")))
        if tag not in INLINE:
            self.block += 1
            self.elements.append(path)
        elif tag == "br":
            self.texts.append((self.stack[-1][1] if self.stack else "", " ", self.block))
        if tag not in VOID:
            self.places[tag].append(len(self.stack))
            self.stack.append((tag, path))

    def _below(self, name: str) -> str:
        if not self.stack:
            return name
        around = self.stack[-1][1]
        if len(self.stack) < DEPTH:
            return f"{around}/{name}"
        upper, _, lower = around.partition("/~")
        kinds = "".join(sorted(_kinds(f"~{lower}") | _kinds(name)))
        return f"{upper}/~{kinds}:{blake2b(f'{lower}/{name}'.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def _words(name: str) -> tuple[str, list[str]]:
    """Tag, and class words and id, of one element of a path."""
    tag, _, marks = name.replace("#", ".").partition(".")
    return tag, marks.split(".") if marks else []


def _is_named(word: str) -> bool:
    parts = [x for x in word.replace("_", "-").split("-") if x]
    return word.startswith("@") or any(x in NAMED for x in parts) and all(x in NAMED or x in PARTS for x in parts)


def kind(name: str) -> str:
    """What an element is by its tag and its own class words, as a letter: hidden, beside by tag or role, a form, reader
    comments, named like a side part, or nothing."""
    tag, words = _words(name)
    if tag in HIDDEN:
        return "h"
    if tag in BESIDES or any(w.startswith("@") for w in words):
        return "f" if tag == "form" else "b"
    named = [w for w in words if _is_named(w)]
    if any(x in COMMENTS for w in named for x in w.replace("_", "-").split("-")):
        return "c"
    return "n" if named and tag not in ("html", "body") else ""


def _kinds(name: str) -> frozenset[str]:
    if name.startswith("~"):  # the elements below the depth that is written out
        return frozenset(name[1:].partition(":")[0])
    known = worker_cache().setdefault("element_kinds", {})
    if name not in known:
        if len(known) > 10_000:
            known.clear()
        known[name] = frozenset(kind(name))
    return known[name]


def standing(path: str, memo: dict[str, frozenset[str]], top: str = "") -> frozenset[str]:
    """The kinds of the elements on a path below `top`; `memo` holds what is known for this top."""
    found = memo.get(path)
    if found is None:
        above, _, name = path.rpartition("/")
        found = memo[path] = frozenset() if path == top or not path else standing(above, memo, top) | _kinds(name)
    return found


def _within(path: str, top: str) -> bool:
    return not top or path == top or path.startswith(top + "/")


def _sums(chars: dict[str, int]) -> Counter:
    """The characters of every path and all paths below it, summed upwards once."""
    total, levels = Counter(), defaultdict(set)
    for path, n in chars.items():
        path = path.partition("/~")[0]
        total[path] += n
        levels[path.count("/")].add(path)
    for depth in range(max(levels, default=0), 0, -1):
        for path in levels[depth]:
            above = path.rpartition("/")[0]
            total[above] += total[path]
            levels[depth - 1].add(above)
    return total


def choose(chars: dict[str, int], linked: dict[str, int]) -> tuple[str, bool]:
    """The slot of the article among template paths with their own text: its path, and whether it is marked as one.

    The slot is chosen before anything is left out. Marked slots (article, main, or named so) win by text, the inner one
    of two nested if it has half of the outer's: first those that stand beside nothing, then those inside a form or an
    element with a name like a side part, as a page may be wrapped in one. Otherwise it is the deepest path that has seven
    tenths of all text that is neither beside nor mostly links, with forms counted if there is no other text.
    """
    memo: dict[str, frozenset[str]] = {}
    free = {p: max(0, n - linked.get(p, 0)) for p, n in chars.items()}
    stands = {p: standing(p, memo) for p in chars}
    everything = _sums({p: n for p, n in free.items() if "h" not in stands[p]})

    def allowing(kinds: str) -> Counter:
        return _sums({p: n for p, n in free.items() if stands[p] <= set(kinds)})

    def marked(path: str) -> int:
        tag, words = _words(path.rpartition("/")[2])
        if any(_is_named(w) for w in words):
            return 0
        return 2 if tag == "article" else 1 if tag == "main" or MAIN_NAMED.search(".".join(words)) else 0

    marks = {p: marked(p) for p in everything}
    named = [p for p in everything if marks[p] and everything[p]]
    for kinds in ("", "f", "fn"):
        places = [p for p in named if standing(p, memo) <= set(kinds)]
        if places:
            total = allowing(kinds)
            best = max(places, key=lambda p: (total[p], everything[p], marks[p], p))
            inner = [p for p in places if p != best and _within(p, best) and 2 * total[p] >= total[best] and marks[p] == 2]
            return (max(inner, key=lambda p: (total[p], p)) if inner else best), True
    for kinds in ("", "f"):
        total = allowing(kinds)
        most = max(total.values(), default=0)
        if most:
            full = [p for p in total if 10 * total[p] >= 7 * most and _words(p.rpartition("/")[2])[0] not in INLINE | {"p"}]
            return max(full, key=lambda p: (p.count("/"), total[p], p), default=""), False
    return "", False


def _home(path: str) -> str:
    """The path of the element that is not inline and holds a text of this path."""
    while path:
        above, _, name = path.rpartition("/")
        if _words(name)[0] not in INLINE:
            break
        path = above
    return path


def _own_text(page: Page) -> tuple[Counter, Counter]:
    chars, linked = Counter(), Counter()
    for path in page.elements:
        chars[path] += 0
    homes: dict[str, tuple[str, bool]] = {}
    for path, text, _ in page.texts:
        if path not in homes:
            home = _home(path)
            homes[path] = home, any(_words(p)[0] == "a" for p in path[len(home):].split("/"))
        home, link = homes[path]
        n = len(text.strip())
        chars[home] += n
        if link:
            linked[home] += n
    return chars, linked


def kept_paths(chars: dict[str, int], top: str) -> set[str]:
    """The paths with text under `top` that are part of the article: not through a hidden element, a part by tag, reader
    comments, or an element named like a side part; but such a name counts for nothing on an element that holds more
    than half of the slot's text."""
    memo: dict[str, frozenset[str]] = {}
    inside = {p: standing(p, memo, top) for p in chars if _within(p, top)}
    if not any(kinds == {"n"} for kinds in inside.values()):
        return {p for p, kinds in inside.items() if not kinds}
    held: Counter = Counter()
    first: dict[str, str] = {}
    for path, kinds in inside.items():
        if kinds == {"n"}:
            first[path] = path
            while memo[first[path].rpartition("/")[0]]:
                first[path] = first[path].rpartition("/")[0]
            held[first[path]] += chars[path]
    most = sum(chars[p] for p, kinds in inside.items() if kinds <= {"n"})
    return {p for p, kinds in inside.items() if not kinds or p in first and 2 * held[first[p]] > most}


def extract(page: Page, top: str, fixed: set[str]) -> str:
    """Text of all blocks under `top`, without what stands beside an article and without the template's own texts."""
    blocks: dict[int, list[str]] = defaultdict(list)
    chars: Counter = Counter()
    for path, text, _ in page.texts:
        chars[path] += len(text.strip())
    kept = kept_paths(chars, top)
    for path, text, block in page.texts:
        if path in kept and not (fixed and _text_token(path, text) in fixed):
            blocks[block].append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def _host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def _text_token(path: str, text: str) -> str:
    """Token of a text node: its path and text; of a long text its start and a hash of the whole."""
    text = text.strip()
    if len(text) >= 200:
        text = f"{text[:40]}\t{blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"
    return f"{path}\t{text}"


_TOKENS = "host string, page long, tokens array<struct<token:string,times:long,chars:long,linked:long>>"


def _tokens(batches):
    """(host, page, tokens) per page: its distinct tokens; a token is a path, or a path and a text. `chars` of a path is
    its own text, that of a text its length."""
    for batch in small_batches(batches):
        rows = {n: [] for n in ("token", "times", "chars", "linked")}
        ends = [0]
        for html in batch.column(1).to_pylist():
            page = Page(html or "")
            chars, linked = _own_text(page)
            times = Counter(page.elements)
            for path, text, _ in page.texts:
                if text.strip():
                    token = _text_token(path, text)
                    times[token] += 1
                    chars[token] += len(text.strip())
            rows["token"].extend(times)
            rows["times"].extend(times.values())
            rows["chars"].extend(chars.get(t, 0) for t in times)
            rows["linked"].extend(linked.get(t, 0) for t in times)
            ends.append(len(rows["token"]))
        fields = [pa.array(rows["token"], pa.string()), *(pa.array(rows[n], pa.int64()) for n in ("times", "chars", "linked"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, list(rows)))],
            ["host", "page", "tokens"])


def _witnessed(batches):
    """(host, token, rest) per page and each of the host's fixed texts it has in the slot: a hash of its other text there.
    A page whose other text is shorter than its fixed texts bears no witness: it may be a copy of an article."""
    for batch in small_batches(batches):
        found = []
        hosts, pages, tops, slots = (batch.column(c).to_pylist() for c in range(4))
        known: dict[tuple[str, str], bool] = {}
        for host, tokens, top, texts in zip(hosts, pages, tops, slots):
            texts, has, rest, size = set(texts), [], [], 0
            for token in tokens:
                path, tab, _ = token["token"].partition("\t")
                if not tab:
                    continue
                if (path, top) not in known:
                    known[path, top] = _within(path, top) and not standing(path, {}, top)
                if known[path, top]:
                    if token["token"] in texts:
                        has.append(token["token"])
                        size -= token["chars"]
                    else:
                        rest.append(token["token"])
                        size += token["chars"]
            if has and rest and size >= 0:
                digest = int.from_bytes(blake2b("\n".join(sorted(rest)).encode(), digest_size=8).digest(), "big", signed=True)
                found.extend((host, token, digest) for token in has)
        columns = list(zip(*found)) if found else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                          pa.array(columns[2], pa.int64())], ["host", "token", "rest"])


def _template(table: pa.Table) -> pa.Table:
    """The template of one host from the tokens that are on enough of its pages: its classes, nested, and their slot.

    The rows are few: no more than twice the tokens of a mean page reach this place.
    """
    rows = table.to_pylist()
    classes = defaultdict(list)
    for row in rows:
        classes[row["pages"], row["times"], row["vector"]].append(row)
    valid = [row for members in classes.values() if len(members) >= CLASS_TOKENS for row in members]
    paths = {row["token"] for row in valid if "\t" not in row["token"]}
    # nesting: an element belongs to the template only if all elements around it do
    nested = {p for p in paths if all(q in paths for q in _around(p))}
    chars = Counter({p: 0 for p in nested})
    linked: Counter = Counter()
    for row in rows:
        if "\t" not in row["token"]:
            home = next((q for q in [row["token"], *_around(row["token"])] if q in nested), None)
            if home:
                chars[home] += row["chars"]
                linked[home] += row["linked"]
    top, marked = choose(chars, linked)
    texts = [(row, _home(row["token"].partition("\t")[0])) for row in valid if "\t" in row["token"]]
    if marked:
        # a marked article's own elements hold texts that differ by page, those of notices inside it do not
        own, ours = {row["token"]: row["chars"] for row in rows}, Counter()
        for row, home in texts:
            ours[home] += row["chars"]
        texts = [(row, home) for row, home in texts if _within(home, top) and ours[home] >= OWN * own.get(home, 0) > 0]
    fixed = sorted(row["token"] for row, _ in texts)
    return pa.table({"host": [rows[0]["host"]], "top": [top], "fixed": pa.array([fixed], pa.list_(pa.string()))})


def _around(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(len(parts) - 1, 0, -1)
            if parts[n - 1].split(".")[0].split("#")[0] not in INLINE]


def templates(pages: DataFrame) -> DataFrame:
    """(host, top, fixed) per host with a template: the path of its article slot and the texts that belong to the template.

    Pages of equal html count once. Occurrence vectors are compared by their length, sum and hash, which are added up
    page by page before any shuffle, so a host with a third of all pages costs no task more than its own tokens. A text
    of the slot is the template's only if enough pages that have it differ in their other text, so copied articles stay.
    """
    rows = pages.select(_host("url").alias("host"), "html", F.xxhash64("html").alias("page")).where("host <> ''")
    known = materialize(rows.mapInArrow(_tokens, _TOKENS).groupBy("host", "page").agg(F.first("tokens").alias("tokens")),
                        "page-tokens")
    tokens = known.select("host", "page", F.inline("tokens")).groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum("times").alias("times"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    sizes = materialize(known.groupBy("host").agg(F.count("*").alias("host_pages")), "host-pages")
    common = (materialize(tokens.where("pages > 1"), "tokens").join(sizes, "host")
              .where(F.col("pages") >= SUPPORT * F.col("host_pages")).drop("host_pages"))
    specs = materialize(common.groupBy("host").applyInArrow(_template, "host string, top string, fixed array<string>"),
                        "templates")
    seen = known.join(specs.where("size(fixed) > 0"), "host").select("host", "tokens", "top", "fixed")
    texts = (seen.mapInArrow(_witnessed, "host string, token string, rest long").distinct().groupBy("host", "token").count()
             .join(sizes, "host").where((F.col("count") >= WITNESSES) & (F.col("count") >= SUPPORT * F.col("host_pages")))
             .groupBy("host").agg(F.array_sort(F.collect_list("token")).alias("kept")))
    return materialize(specs.join(texts, "host", "left").select(
        "host", "top", F.coalesce("kept", F.array().cast("array<string>")).alias("fixed")), "specs")


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by two line feeds), n_chars.

    A page whose host has no template, or that lacks its slot, is read by the same choice over its own elements. A null
    html is empty, and so is the text of a page without one; repeated rows are read each. Any string is a page: malformed
    and deeply nested markup is read in time that grows with its length.
    """
    kinds = dict(pages.dtypes)
    specs = templates(pages)
    rows = pages.select("page_id", "url", "html", _host("url").alias("host")).join(specs, "host", "left").select(
        "page_id", "url", "html", "top", "fixed")

    def read(batches):
        for batch in small_batches(batches):
            found = []
            for html, top, fixed in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                page = Page(html or "")
                if not top or top not in page.elements:
                    top, fixed = choose(*_own_text(page))[0], None
                found.append(extract(page, top, set(fixed or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
