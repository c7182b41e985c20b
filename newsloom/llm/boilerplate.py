"""Main text of web pages by structure and a suffix array per host.

A page is parsed into blocks of visible text. Blocks under menus, headers, footers, sidebars,
notices, adverts, forms and comments are not its text; where it has an article (or main) element,
neither is what stands outside of that. All other blocks, article blocks included, are decided by
the host: the token streams of its pages are concatenated, the suffixes are sorted, and every
substring of MIN_RUN tokens that begins suffixes of enough distinct pages (a tenth of them, two at
least, three within articles) is a repeated run. A block that such runs cover for the larger part
is boilerplate; unique runs are kept whole.

Distinct pages are pages of distinct content: a page is a copy if two thirds of its article text (eight
ninths of its text where it has no article, since menus may be most of it) stand on earlier pages of the
host, in the order of a hash of the page. Copies have no vote, so that they cannot vote an article away;
the verdict on their blocks is that of the others. Article blocks are counted in article blocks only, so
that teasers of an article elsewhere do not count against it.

Classes, ids and roles hide small elements only, and nothing of an article's running text; within an
article a name counts if all its words are such names or plain ones (share-box, but not share-price).
An article whose own name is of that kind, as a reader's comment, is no article. A named element that holds the article, or the
larger part of the page's text in several blocks, is a wrapper and hides nothing by its name.

The voting pages of a host are dealt to shards of bounded size, each of which is one array. A run with a
tenth of a host's votes has a tenth of those of one shard at least, so what the arrays propose holds every
run of the host; proposals are then counted over all shards. The result depends on the host's pages alone,
not on the size or number of shards. In the last step each page looks up its host's runs.

White space within a block becomes one space, character references are decoded, blocks are joined
by a newline in page order. A null html is an empty page; a null url is a host of its own. Repeated
rows are separate pages. Nothing is capped.
"""

from __future__ import annotations

import bz2
import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import bloom, cut, in_bloom, small, small_batches, sweep_shuffles

#: Tokens of a run, one in how many of the host's distinct pages a run must stand on, share of a block, pages of a shard.
MIN_RUN, ONE_IN, COVER, SHARD_PAGES = 6, 10, 0.5, 500
#: Distinct pages that a run must stand on at least, anywhere and within articles; bins of a sketch.
LEAST, LEAST_MAIN, BINS = 2, 3, 32
#: A page is a copy if all but one in so many bins of its sketch are those of earlier pages, with and without an article.
COPY_MAIN, COPY_OPEN = 3, 9

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: elements whose content is not text, elements that are never article text, and elements that end a block
_RAW = frozenset("script style noscript template textarea svg iframe object head title".split())
_OUTSIDE = frozenset("nav header footer aside form menu dialog select button".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
#: words in class, id or role of elements that are not article text
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo comment comments discussion disqus cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead toolbar share sharing social related recommended pagination widget search contentinfo complementary".split()
)
#: words that may stand beside a listed one in a name; in an article, a name with any other word (share-price) hides nothing
_PLAIN = frozenset(
    "a an and area at b bar block bottom box btn button buttons c card cards col column container content css div element entry form group header head heading icon icons id inline inner item items js label left link links list main module o of page panel placeholder post posts primary right row secondary section site slot small strip tag text thread tile title tools top unit ui view wrap wrapper x y z".split()
)
#: elements of running text, which in an article no name hides
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: of the listed words, those that within an article name its own head, and words of elements that may outgrow the article
_HEAD = frozenset("header masthead".split())
_LONG = frozenset("comment comments discussion disqus".split())
_IMPLIED = {
    "p": frozenset(("p",)), "li": frozenset(("li",)), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
    "tr": frozenset(("tr", "td", "th")), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",))
}

MAIN, OPEN, OUT = 1, 0, -1


def _names(attributes: str, strict: bool = False) -> frozenset[str]:
    """The listed words in class, id and role; strict counts only names that consist of listed and plain words."""
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = {w for w in re.split(r"[^a-z]+", name) if w}
            if not strict or words <= _NAMES | _PLAIN:
                found |= words & _NAMES
    return frozenset(found)


_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}


def _wrappers(found: list[tuple[str, bool, bool, tuple[int, ...]]], words: list[frozenset[str]], titled: set[int]) -> set[int]:
    """The named elements that are wrappers; found has (text, hidden by structure, inside an article, named elements around)."""
    open_text = [(len(t.split()), inside, around) for t, hidden, inside, around in found if not hidden]
    total, held, pieces = sum(n for n, _, _ in open_text), {}, {}
    for n, _, around in open_text:
        for e in around:
            held[e], pieces[e] = held.get(e, 0) + n, pieces.get(e, 0) + 1
    out = {e for e, n in held.items() if 2 * n > total and (e in titled or pieces[e] > 1 and _LONG.isdisjoint(words[e]))}
    # names must not hide every article, or else all text: the outermost ones around it give way; articles among comments come last
    for main, long in ((True, False), (False, False), (True, True)):
        if main and long and any(out.issuperset(a) for _, _, a in open_text):
            break
        around = [[e for e in a if e not in out] for _, inside, a in open_text if inside or not main]
        around = [a for a in around if long or not main or all(_LONG.isdisjoint(words[e]) for e in a)]
        while around and all(around):
            depth = min(map(len, around))
            lift = {a[0] for a in around if len(a) == depth and (main or pieces[a[0]] > 1 and _LONG.isdisjoint(words[a[0]]))}
            if not lift:
                break
            out |= lift
            around = [[e for e in a if e not in out] for a in around]
    return out


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, MAIN, OPEN or OUT) of the blocks of a page in order."""
    found: list[tuple[str, bool, bool, tuple[int, ...]]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # open elements: whether each hides its content, its number if its names may, whether it is the article
    words: list[frozenset[str]] = []  # of the named elements
    around: list[int] = []
    titled: set[int] = set()
    hidden = inside = at = 0
    text: list[str] = []

    def close_block() -> None:
        nonlocal text
        if text:
            body = " ".join(entities.unescape("".join(text)).split())
            if body:
                found.append((body, bool(hidden), bool(inside), tuple(around)))
            text = []

    def pop() -> None:
        nonlocal hidden, inside
        _, hides, number, main = stack.pop()
        hidden -= hides
        inside -= main
        if number >= 0:
            around.pop()

    while at < len(page):
        m = _PIECE.match(page, at)
        at = m.end()
        name = m[2]
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCK:
                close_block()
            if any(name == s[0] for s in stack):
                while stack and stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _BLOCK:
            close_block()
        elif name == "br":
            text.append(" ")
        if name in _VOID or m[3].endswith("/"):
            continue
        if name in _RAW and name != "head":
            # raw content ends at its end tag and nowhere else; comment marks in it are content
            end = _ENDS[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        implied = _IMPLIED.get(name)
        while implied and stack and stack[-1][0] in implied:
            pop()
        # a header within an article is part of it
        hides = name == "head" or name in _OUTSIDE and not (name == "header" and inside and not hidden)
        number, listed, main = -1, frozenset(), name in _MAIN
        if main:
            # an article whose name says that it is a comment or a teaser is none
            listed = _names(m[3], True)
            main = not listed
        elif name == "h1":
            titled.update(around)
        elif not hides and name not in ("body", "html") and not (inside and name in _PROSE):
            listed = _names(m[3], bool(inside))
            if inside:
                listed -= _HEAD
        if listed:
            number = len(words)
            words.append(listed)
            around.append(number)
        stack.append((name, hides, number, main))
        hidden += hides
        inside += main
    close_block()
    lifted = _wrappers(found, words, titled) if words else set()
    return [(t, OUT if h or not lifted.issuperset(a) else MAIN if i else OPEN) for t, h, i, a in found]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _ranks(streams: list[list[int]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each suffix by its first `run` tokens, end of its page).

    The suffix array of all streams is built by prefix doubling until suffixes are ordered by
    their first `run` tokens, when suffixes of equal rank share such a run.
    """
    size = [len(x) for x in streams]
    page = np.repeat(np.arange(len(streams)), size)
    # a suffix ends with its page: page ends sort as tokens of their own
    end = np.repeat(np.cumsum(size), size)
    token = np.concatenate([np.asarray(x) for x in streams])
    _, rank = np.unique(token, return_inverse=True)
    length = 1
    while length < run:
        step = min(length, run - length)
        ahead = np.arange(page.size) + step
        follow = np.where(ahead < end, rank[np.minimum(ahead, page.size - 1)] + len(streams), page)
        _, rank = np.unique(rank * (page.size + len(streams)) + follow, return_inverse=True)
        length += step
    return rank, end


def _votes(rank: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a position of each rank among the positions `at`, number of owners that have it there)."""
    owners, of = np.unique(owner[at], return_inverse=True)
    pairs = np.sort(rank[at] * max(1, owners.size) + of)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: pairs.size]]
    found, votes = np.unique(pairs // max(1, owners.size), return_counts=True)
    place = np.zeros(rank.size, np.int64)
    place[rank[at]] = at
    return place[found], votes


def _cover(begins: np.ndarray, run: int) -> np.ndarray:
    """Which tokens are covered by the runs of `run` tokens that begin where `begins` is true."""
    step, at = np.zeros(begins.size + run, np.int32), np.flatnonzero(begins)
    step[at] += 1
    step[at + run] -= 1
    return np.cumsum(step)[: begins.size] > 0


def repeated(streams: list[list[int]], run: int = MIN_RUN) -> list[np.ndarray]:
    """For each page's tokens: whether a run of `run` tokens that enough pages have covers it."""
    size = [len(x) for x in streams]
    if not sum(size):
        return [np.zeros(0, bool) for _ in size]
    rank, end = _ranks(streams, run)
    whole = np.arange(rank.size) + run <= end
    at, votes = _votes(rank, np.repeat(np.arange(len(size)), size), np.flatnonzero(whole))
    again = np.zeros(rank.size, bool)
    again[rank[at[votes >= max(LEAST, -(-len(size) // ONE_IN))]]] = True
    return np.split(_cover(again[rank] & whole, run), np.cumsum(size)[:-1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words of each block) of UTF-8 in which spaces part words and line ends part blocks."""
    if not text.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gaps = np.flatnonzero((text == 32) | (text == 10))
    starts, length = np.r_[0, gaps + 1], np.diff(np.r_[-1, gaps, text.size])
    power = np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)
    power = np.multiply.accumulate(power)
    value = power[np.arange(text.size, dtype=np.int32 if text.size < 1 << 31 else np.int64) - np.repeat(starts, length)[: text.size]]
    value *= text + np.uint64(1)
    value[gaps] = 0
    return _mix(np.add.reduceat(value, starts)), np.diff(np.r_[-1, np.flatnonzero(text[gaps] == 10), gaps.size])


class Pages:
    """Tokens of some pages of blocks, and the hash of the run that begins at each; equal on all machines."""

    def __init__(self, texts: list[list[str]], kinds: list[list[int]], run: int = MIN_RUN):
        text = "\n".join(t for page in texts for t in page).lower().encode()
        self.token, self.words = _words(np.frombuffer(text, np.uint8))
        self.blocks = [len(page) for page in texts]
        block_end = np.r_[0, np.cumsum(self.words)]
        self.size = np.diff(block_end[np.r_[0, np.cumsum(self.blocks, dtype=np.int64)]])  # of each page
        self.page = np.repeat(np.arange(len(texts)), self.size)
        self.kind = np.fromiter((k for page in kinds for k in page), np.int8)
        self.of = np.repeat(self.kind, self.words)
        self.main = np.array([MAIN in page for page in kinds], bool)
        self.run, n = run, self.token.size
        self.whole = np.arange(n) + run <= np.repeat(np.cumsum(self.size), self.size)
        self.hash, begins = np.zeros(n, np.uint64), max(0, n - run + 1)
        for k in range(run if begins else 0):
            self.hash[:begins] = _mix(self.hash[:begins] * np.uint64(0x9E3779B97F4A7C15) + self.token[k : k + begins])

    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        """(32 bits of the least hash in each of BINS bins of each page's article runs, or of its open ones; whether the bin is used)."""
        content = self.whole & (self.of == np.where(self.main, MAIN, OPEN)[self.page])
        h = self.hash[content]
        at = self.page[content] * BINS + (h % np.uint64(BINS)).astype(np.int64)
        least, used = np.full(len(self.blocks) * BINS, np.iinfo(np.uint64).max), np.zeros(len(self.blocks) * BINS, bool)
        np.minimum.at(least, at, h)
        used[at] = True
        return (least >> np.uint64(8)).astype(np.uint32).view(np.int32).reshape(-1, BINS), used.reshape(-1, BINS)

    def proposed(self, owner: np.ndarray, alone: bool) -> list[np.ndarray]:
        """Hashes of the runs that have a tenth of the owners' votes, anywhere and within articles; alone applies the least numbers, too."""
        if not self.token.size:
            return [np.zeros(0, np.int64)] * 2
        rank, _ = _ranks(np.split(self.token, np.cumsum(self.size)[:-1]), self.run)
        out = []
        for where, of, least in ((self.whole, np.ones(self.main.size, bool), LEAST), (self.whole & (self.of == MAIN), self.main, LEAST_MAIN)):
            at, votes = _votes(rank, owner[self.page], np.flatnonzero(where))
            enough = ONE_IN * votes >= np.unique(owner[of]).size
            out.append(self.hash[at[enough & (votes >= least) if alone else enough]].view(np.int64))
        return out

    def counted(self, owner: np.ndarray, wanted: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hash, owners that have it) of the wanted runs, anywhere and within articles."""
        out = []
        for where, runs in zip((self.whole, self.whole & (self.of == MAIN)), wanted, strict=True):
            at = np.flatnonzero(where & np.isin(self.hash, runs.view(np.uint64)))
            _, rank = np.unique(self.hash[at], return_inverse=True)
            place, votes = _votes(rank, owner[self.page[at]], np.arange(at.size))
            out.append((self.hash[at[place]].view(np.int64), votes))
        return out

    def verdicts(self, runs: list[np.ndarray], cover: float = COVER) -> list[list[tuple[int, bool]]]:
        """Kind of each block after the verdict of repeated runs, anywhere and within articles, and whether it is repeated."""
        anywhere = _cover(self.whole & np.isin(self.hash, runs[0].view(np.uint64)), self.run)
        article = _cover(self.whole & (self.of == MAIN) & np.isin(self.hash, runs[1].view(np.uint64)), self.run)
        sums = np.r_[0, np.cumsum(np.where(self.of == MAIN, article, anywhere))]
        ends = np.cumsum(self.words)
        again = sums[ends] - sums[ends - self.words] > cover * self.words
        blocks = iter(zip(np.where(again, OUT, self.kind).tolist(), again.tolist(), strict=True))
        return [[next(blocks) for _ in range(n)] for n in self.blocks]


def is_copy(main: Column | np.ndarray, used: Column | np.ndarray, first: Column | np.ndarray):
    """Whether a page has no vote: of its used bins too few are first on it."""
    return (used > 0) & (main & (COPY_MAIN * first <= used) | ~main & (COPY_OPEN * first <= used))


def judge(texts: list[list[str]], kinds: list[list[int]], run: int = MIN_RUN, cover: float = COVER, order: list[int] | None = None) -> list[list[tuple[int, bool]]]:
    """Kind of each block of one host's pages after the suffix array's verdict, and whether it is repeated: extract() of one array.

    Pages of equal order are one.
    """
    pages, owner = Pages(texts, kinds, run), np.arange(len(texts)) if order is None else np.array(order)
    sketch, used = pages.sketch()
    least: dict[tuple[bool, int, int], int] = {}
    keys = [[(bool(m), int(k), int(row[k])) for k in np.flatnonzero(u)] for m, row, u in zip(pages.main, sketch, used, strict=True)]
    for o, page in zip(owner, keys, strict=True):
        for key in page:
            least[key] = min(o, least.get(key, o))
    first = np.array([sum(least[key] == o for key in page) for o, page in zip(owner, keys, strict=True)])
    votes = np.flatnonzero(~is_copy(pages.main, used.sum(1), first))
    voters = Pages([texts[i] for i in votes], [kinds[i] for i in votes], run)
    return pages.verdicts(voters.proposed(owner[votes], True), cover)


PARSED = "page_id bigint, url string, host string, h bigint, main boolean, sketch array<int>, body binary"
RUNS = "host string, runs array<bigint>, main_runs array<bigint>"
COUNTED = "host string, main boolean, run bigint, votes bigint"
RESULT = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_repeated bigint"


def pack(page: list[tuple[str, int]]) -> bytes:
    """The blocks of a page and their kinds, compressed; no block holds a line end."""
    return bz2.compress(bytes(k + 1 for _, k in page) + b"\n" + "\n".join(t for t, _ in page).encode(), 1)


def unpack(bodies: pa.ChunkedArray | list[bytes]) -> tuple[list[list[str]], list[list[int]]]:
    texts, kinds = [], []
    for body in bodies:
        head, _, text = bz2.decompress(body if isinstance(body, bytes) else body.as_py()).partition(b"\n")
        kinds.append([k - 1 for k in head])
        texts.append(text.decode().split("\n") if head else [])
    return texts, kinds


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 250):
            batch = whole.slice(at, 250)
            found = [blocks(x or "") for x in batch.column("html").to_pylist()]
            # where a page has an article, what is open outside of it is not part of it
            found = [[(t, OUT if k == OPEN and any(j == MAIN for _, j in page) else k) for t, k in page] for page in found]
            pages = Pages([[t for t, _ in page] for page in found], [[k for _, k in page] for page in found])
            sketch, used = pages.sketch()
            bins = pa.ListArray.from_arrays(np.arange(0, sketch.size + 1, BINS, dtype=np.int32), pa.array(sketch.ravel(), pa.int32(), mask=~used.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host", "h")), pa.array(pages.main), bins, pa.array(map(pack, found), pa.binary())],
                names=[x.split()[0] for x in PARSED.split(", ")]
            )


def _voters(bitmap) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops pages that have no vote, but for the few that the bitmap of those with a vote lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(bitmap.value, batch.column("h").to_numpy().view(np.uint64))))

    return run


def _shard(part: pa.Table, copies: np.ndarray) -> tuple[Pages, np.ndarray]:
    """The pages of a shard that have a vote, and their owners."""
    owner = part.column("h").to_numpy()
    part = part.filter(pa.array(~np.isin(owner, copies)))
    return Pages(*unpack(part.column("body"))), part.column("h").to_numpy()


def _lists(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.array(table.column(c).combine_chunks().flatten(), np.int64) for c in names]


def _propose(part: pa.Table, copies: pa.Table) -> pa.Table:
    schema = pa.schema([("host", pa.string()), ("runs", pa.list_(pa.int64())), ("main_runs", pa.list_(pa.int64()))])
    if not part.num_rows:
        return schema.empty_table()
    pages, owner = _shard(part, copies.column("h").to_numpy())
    found = pages.proposed(owner, part.column("shards")[0].as_py() == 1)
    return pa.table([part.column("host")[:1], *(pa.array([x], pa.list_(pa.int64())) for x in found)], schema)


def _count(part: pa.Table, side: pa.Table) -> pa.Table:
    """side holds the copies of the shard, and the proposals of its host."""
    schema = pa.schema([("host", pa.string()), ("main", pa.bool_()), ("run", pa.int64()), ("votes", pa.int64())])
    if not part.num_rows:
        return schema.empty_table()
    pages, owner = _shard(part, side.column("h").drop_null().to_numpy())
    host, found = part.column("host")[0].as_py(), pages.counted(owner, _lists(side, "runs", "main_runs"))
    return pa.concat_tables(
        pa.table([pa.array([host] * run.size, pa.string()), pa.array([main] * run.size, pa.bool_()), run, votes], schema)
        for main, (run, votes) in zip((False, True), found, strict=True)
    )


def _finish(part: pa.Table, runs: pa.Table) -> pa.Table:
    texts, kinds = unpack(part.column("body"))
    verdicts = Pages(texts, kinds).verdicts(_lists(runs, "runs", "main_runs"))
    kept = ["\n".join(t for t, (k, _) in zip(page, v, strict=True) if k != OUT) for page, v in zip(texts, verdicts, strict=True)]
    return pa.table({
        "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(kept, pa.string()), "n_chars": pa.array([len(t) for t in kept], pa.int64()),
        "n_blocks": pa.array([len(v) for v in verdicts], pa.int64()), "n_repeated": pa.array(
            [sum(again for _, again in v) for v in verdicts], pa.int64()
        ),
    })


def _cogroup(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    return left.groupBy("host", "shard").cogroup(right.groupBy("host", "shard")).applyInArrow(run, schema)


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES, most_broadcast: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_repeated of every row.

    Only hosts of more than one shard are looked up; they are broadcast if there are few. shard_pages changes no result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("h"))
    parsed = cut(rows.mapInArrow(_parse, PARSED), "blocks")

    # which pages have a vote
    bins = parsed.select("host", "main", "h", F.posexplode("sketch").alias("bin", "least")).where("least is not null")
    first = bins.select(F.xxhash64("host", "main", "bin", "least").alias("key"), "h").groupBy("key").agg(F.min("h").alias("h")).groupBy("h").agg(F.count("*").alias("first"))
    own = parsed.select("host", "h", "main", F.size(F.filter("sketch", F.isnotnull)).alias("used")).groupBy("host", "h", "main", "used").agg(F.count("*").alias("rows"))
    own = own.join(first, "h", "left").withColumn("vote", ~is_copy(F.col("main"), F.col("used"), F.coalesce("first", F.lit(0))))
    voters = cut(own.select("host", "h", "main", "rows", "vote"), "voters")
    hosts = voters.groupBy("host").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("vote") / shard_pages)).cast("int").alias("shards"), F.ceil(F.sum("rows") / shard_pages).cast("int").alias("page_shards"),
        F.count_if("vote").alias("voters"), F.count_if(F.col("vote") & F.col("main")).alias("main_voters")
    )
    hosts = cut(hosts, "hosts")
    large = small(hosts.where("page_shards > 1").select("host", "shards", "page_shards"), most_broadcast)
    many = lambda x: x.join(large, "host", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("shards", "page_shards")})
    shard = F.pmod("h", "shards").cast("int").alias("shard")

    # what the arrays propose, counted where a host has several
    bitmap = spark.sparkContext.broadcast(bloom(voters.where("vote"), "h"))
    texts = many(parsed.select("host", "h", "body").mapInArrow(_voters(bitmap), "host string, h bigint, body binary")).select("host", shard, "shards", "h", "body")
    copies = many(voters.where("not vote").select("host", "h")).select("host", shard, "h", "shards")
    proposed = cut(_cogroup(texts, copies.drop("shards"), _propose, RUNS), "proposed")
    sweep_shuffles(spark)
    shared = hosts.where("shards > 1")
    each = lambda main, runs: proposed.join(F.broadcast(shared.select("host")), "host", "left_semi").select("host", F.lit(main).alias("main"), F.explode(runs).alias("run"))
    wanted = each(False, "runs").union(each(True, "main_runs")).distinct()
    side = _as_lists(wanted).join(shared.select("host", "shards"), "host").select("host", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.lit(None).cast("bigint").alias("h"), "runs", "main_runs")
    none = F.array().cast("array<bigint>")
    side = side.union(copies.where("shards > 1").select("host", "shard", "h", none, none))
    counted = _cogroup(texts.where("shards > 1"), side, _count, COUNTED).groupBy("host", "main", "run").agg(F.sum("votes").alias("votes"))
    least = lambda c, n: F.greatest(F.lit(n), F.ceil(F.col(c) / ONE_IN))
    enough = F.when(F.col("main"), least("main_voters", LEAST_MAIN)).otherwise(least("voters", LEAST))
    counted = cut(_as_lists(counted.join(shared, "host").where(F.col("votes") >= enough).select("host", counted["main"], "run")), "counted")
    sweep_shuffles(spark)

    # each page looks them up
    runs = counted.union(proposed.join(shared.select("host"), "host", "left_anti"))
    runs = many(runs).select("host", F.explode(F.expr("sequence(0, page_shards - 1)")).alias("shard"), "runs", "main_runs")
    place = F.pmod(F.monotonically_increasing_id(), "page_shards").cast("int").alias("shard")
    return _cogroup(many(parsed).select("host", place, "page_id", "url", "body"), runs, _finish, RESULT)


def _as_lists(runs: DataFrame) -> DataFrame:
    """host, main, run as one row per host."""
    some = lambda c: F.collect_list(F.when(c, F.col("run")))
    return runs.groupBy("host").agg(some(~F.col("main")).alias("runs"), some(F.col("main")).alias("main_runs"))
