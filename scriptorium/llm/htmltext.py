"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold that isn't linked or boilerplate. The best one, the page's
lead, votes for its path, generalised to tags and classes and cast as a hash; what stands beside it, up to the
container that leaves no text out, votes too, as a part of a page with that lead. Votes are counted for each host in Spark: leads
that several pages have win, and a part belongs to the article if enough of the lead's pages have it, with texts of their
own. Every page is extracted again with the winning lead that has most votes, and its parts: unnamed blocks that few pages
have, or that say the same everywhere, go. Only a page on which the winners hold next to nothing speaks for itself.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches

# Elements of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object xmp noembed noframes".split())
SKIPPED = frozenset("script style noscript template iframe svg object head title nav header footer aside form button select option textarea dialog menu input audio video canvas xmp noembed noframes annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: Class names and ids of boilerplate, whole, and what such names begin with before a hyphen; other parts of a name such as has-sidebar say nothing about what the element is.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer foot "
    "sidebar side aside widget related recommended share sharing social comment comments disqus reply replies cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe "
    "subscription signup login form search pagination pager toolbar skip copyright legal "
    "site-header site-footer page-footer site-nav site-navigation main-nav main-navigation main-menu nav-menu cookie-banner cookie-notice cookie-consent skip-link related-posts comment-list comments-area share-buttons "
    "left-sidebar right-sidebar left-nav right-nav top-nav side-nav primary-nav secondary-nav site-menu top-menu mobile-menu article-footer post-footer entry-footer user-comments reader-comments post-comments "
    "article-comments comment-form comment-respond post-navigation privacy-notice gdpr-banner".split()
)
NOISE_HEADS = frozenset("sidebar advert adverts advertisement cookie cookies newsletter comments breadcrumb breadcrumbs navbar navigation pagination disqus masthead footer".split())
#: First and second parts of boilerplate names whose first part alone says too little.
NOISE_PAIRS = frozenset(
    f"{a}-{b}"
    for heads, tails in (("ad ads", "slot unit box container banner wrapper block top bottom inline space"), ("share social sharing", "bar links icons list box"), ("related", "articles links stories items"), ("nav menu", "bar links main container list"))
    for a in heads.split()
    for b in tails.split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    step: str = ""
    noise: bool = False
    named: bool = False
    parent: "Node | None" = None
    children: list = field(default_factory=list)

    @property
    def path(self) -> str:
        """Steps (tag and classes) from the root down, apart by spaces, which no step holds; empty for the root."""
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return " ".join(reversed(steps))

    @property
    def key(self) -> int:
        """The path's hash."""
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return _key(reversed(steps))


def _next(key: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), key)


def _key(steps) -> int:
    key = 0
    for step in steps:
        key = _next(key, step)
    return key


def path_key(path: str) -> int:
    return _key(path.split(" ") if path else ())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _noisy(tag: str, at: dict[str, str]) -> bool:
    return tag in SKIPPED or "hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in NOISE_ROLES


def _noise_named(tag: str, at: dict[str, str]) -> bool:
    return tag not in ("article", "main", "body", "html") and any(_is_noise(name.lower().replace("_", "-")) for k in ("class", "id") for name in at.get(k, "").split())


def _is_noise(name: str) -> bool:
    first, _, rest = name.partition("-")
    return name in NOISE or first in NOISE_HEADS or f"{first}-{rest.partition('-')[0]}" in NOISE_PAIRS


def _spare(root: Node, named: list[Node]) -> None:
    """Elements that only their name marks as boilerplate stay if they hold most of the page's unlinked paragraph text (text, where no paragraph has any)."""
    order, stack = [], [(root, False)]
    while stack:
        node, within = stack.pop()
        order.append((node, within))
        stack.extend((c, within or c.tag == "p") for c in node.children if isinstance(c, Node) and (c.named or not c.noise))
    for anywhere in (False, True):
        held: dict[int, int] = {}
        for node, within in reversed(order):
            n = sum((len(c.strip()) if within or anywhere else 0) if isinstance(c, str) else held.get(id(c), 0) for c in node.children)
            held[id(node)] = 0 if node.tag == "a" else n
        if held[id(root)]:
            break
    for node in named:
        if 2 * held.get(id(node), 0) > held[id(root)]:
            node.noise = False


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed elements end with their parent, a block ends an open paragraph."""
    root = Node("#root")
    top, at, size, named = root, 0, len(page), []
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                top.children.append(html.unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option", "body"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ("p",) if tag != "body" else ("head",))
            node = top
            while node is not root and node.tag not in same and node.tag not in (CLOSES_P - {"p"}) and node.tag not in ("td", "th", "table", "body"):
                node = node.parent
            if node is not root and node.tag in same:
                top = node.parent
        at_ = _attributes(m[3])
        classes = ".".join(sorted(_generalised(at_.get("class", ""))))
        hard = _noisy(tag, at_)
        by_name = not hard and _noise_named(tag, at_)
        node = Node(tag, f"{tag}{'.' + classes if classes else ''}", hard or by_name, by_name, top)
        if by_name:
            named.append(node)
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(page[at : end.start() if end else size]))
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
        elif tag not in VOID and tag != "svg":
            top = node  # HTML ignores the slash of an element that isn't void
    if named:
        _spare(root, named)
    return root


def _generalised(value: str) -> list[str]:
    """Class names without what differs from page to page: digits become #, hashes go."""
    return [re.sub(r"\d+", "#", c) for c in value.split() if not re.fullmatch(r"[0-9a-f]{8,}", c)]


def blocks(node: Node, out: list[str] | None = None, line: list[str] | None = None) -> list[str]:
    """The node's text in blocks: boilerplate left out, white space in a block one space, empty blocks left out."""
    out, line, outer = [] if out is None else out, [] if line is None else line, out is None

    def end() -> None:
        if line and (text := _SPACE.sub(" ", "".join(line)).strip()):
            out.append(text)
        line.clear()

    stack = [(iter(node.children), True)]
    while stack:  # without recursion: pages can nest deeply
        for child in stack[-1][0]:
            if isinstance(child, str):
                line.append(child)
            elif child.tag == "br":
                line.append(" ")
            elif not child.noise:
                block = child.tag not in INLINE
                if block:
                    end()
                stack.append((iter(child.children), block))
                break
        else:
            if stack.pop()[1]:
                end()
    end()
    return out if outer else out


def _walk(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)


def _unlinked(order: list[Node]) -> dict[int, int]:
    """Characters in each node that are neither linked nor boilerplate."""
    inside: dict[int, int] = {}
    for node in reversed(order):  # children first
        n = sum(len(c.strip()) if isinstance(c, str) else inside.get(id(c), 0) for c in node.children if isinstance(c, str) or not c.noise)
        inside[id(node)] = 0 if node.tag == "a" else n
    return inside


def _bonus(node: Node) -> float:
    return 2.0 if node.tag in ("article", "main") else 1.0


def scores(root: Node) -> list[tuple[float, Node]]:
    """A score for each container: characters of its own paragraphs, half of those a level below and so on, links not counted."""
    order = list(_walk(root))
    return _scores(root, order, _unlinked(order))


def _scores(root: Node, order: list[Node], inside: dict[int, int]) -> list[tuple[float, Node]]:
    own: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for node in order:
        if node.tag in CONTAINERS or node is root:
            nodes[id(node)] = node
            direct, queue = 0.0, [(c, 1.0) for c in node.children]
            while queue:
                c, weight = queue.pop()
                if isinstance(c, str):
                    direct += weight * len(c.strip())
                elif not c.noise and c.tag != "a":
                    if c.tag in CONTAINERS:
                        direct += weight * 0.5 * inside[id(c)] if weight > 0.5 else 0.0
                    else:
                        queue.extend((d, weight) for d in c.children)
            own[id(node)] = _bonus(node) * direct
    return [(s, nodes[k]) for k, s in own.items()]


@dataclass
class Own:
    """What a page says by itself: its container with the highest score (lead), the lowest one around it that leaves no text out (whole), and the unlinked characters in each node."""

    lead: Node | None
    whole: Node | None
    inside: dict[int, int]


def survey(root: Node) -> Own:
    """An article or main around the lead that holds half of the page's text or more is the outer limit, and lead and whole are one then."""
    order = list(_walk(root))
    inside = _unlinked(order)
    found = _scores(root, order, inside)
    top = max((s for s, _ in found), default=0.0)
    if top <= 0:
        return Own(None, None, inside)
    node = next(n for s, n in found if s == top)
    above = [node]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    if marked := [n for n in above if n.tag in ("article", "main") and 2 * inside[id(n)] >= inside[id(root)]]:
        above = above[: above.index(marked[-1]) + 1]
    most = inside[id(above[-1])]
    whole = next(n for n in above if inside[id(n)] == most)
    return Own(whole if marked else node, whole, inside)


def best(root: Node) -> Node | None:
    """The container with the highest score, or the lowest one around it that leaves no text out; none if nothing has text."""
    return survey(root).whole


#: Step of what stands loose in a container: texts and inline elements, which are one part.
_LOOSE = "#text"


def beside(own: Own) -> dict[int, list]:
    """The parts of whole that stand beside lead: nodes and texts by the key of their path."""
    parts: dict[int, list] = {}
    node = own.lead
    while node is not own.whole:
        at, inner, node = node.parent.key, node, node.parent
        for c in node.children:
            if isinstance(c, str) or (c.tag in INLINE and not c.noise):
                if c.strip() if isinstance(c, str) else blocks(c):
                    parts.setdefault(_next(at, _LOOSE), []).append(c)
            elif c is not inner and not c.noise and blocks(c):
                parts.setdefault(_next(at, c.step), []).append(c)
    return parts


def ballot(root: Node) -> list[tuple[int, int | None, int, int]]:
    """A page's votes (lead, part, page, text): one for its lead, without a part, and one for each part beside it; page and text are hashes of what they hold."""
    own = survey(root)
    if own.lead is None:
        return []
    digest = lambda text: xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    lead, page = own.lead.key, digest("\n".join(blocks(own.whole)))
    out: list[tuple[int, int | None, int, int]] = [(lead, None, page, page)]
    for key, held in beside(own).items():
        out.append((lead, key, page, digest("\n".join(_SPACE.sub(" ", c).strip() if isinstance(c, str) else "\n".join(blocks(c)) for c in held))))
    return out


def _chosen(leads: list[Node], parts: frozenset) -> list[str]:
    """Blocks of the leads, and of what stands beside them on paths in `parts`, in page order."""
    out, line, ends = [], [], {id(n) for n in leads}
    above = set()
    for node in leads:
        while node.parent is not None and id(node.parent) not in above:
            node = node.parent
            above.add(id(node))

    def end() -> None:
        if line and (text := _SPACE.sub(" ", "".join(line)).strip()):
            out.append(text)
        line.clear()

    top = leads[0]
    while top.parent is not None:
        top = top.parent
    if id(top) in ends:
        return blocks(top)
    stack = [(iter(top.children), 0)]
    while stack:
        items, key = stack[-1]
        for c in items:
            if isinstance(c, str):
                if _next(key, _LOOSE) in parts:
                    line.append(c)
                continue
            if id(c) in above or id(c) in ends:
                end()
                if id(c) in ends:
                    out += blocks(c)
                    continue
                stack.append((iter(c.children), _next(key, c.step)))
                break
            if c.noise:
                continue
            if c.tag in INLINE:
                if _next(key, _LOOSE) in parts:
                    line.append(" " if c.tag == "br" else "\n".join(blocks(c)) if not _plain(c) else _plain(c))
                continue
            end()
            if _next(key, c.step) in parts:
                out += blocks(c)
        else:
            end()
            stack.pop()
    end()
    return out


def _plain(node: Node) -> str:
    """All text of an inline element that holds no block, spaces as they are; empty if it does."""
    out, stack = [], [node]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(" ")
        elif not c.noise:
            if c.tag not in INLINE:
                return ""
            stack.extend(reversed(c.children))
    return "".join(out)


#: What a winning lead must hold of the text of the page's own lead to decide over it; with less it is a teaser there.
LEAST_OF_OWN = 0.2
#: A lead wins with so many pages. With JUDGED different pages or more, a part beside it belongs to the article if PART_SHARE of
#: them have it and its texts are not the same over and over: more than REPEATED of its pages have one of their own.
LEAST_VOTES, JUDGED, PART_SHARE, REPEATED = 2, 4, 0.25, 0.25


def extract(root: Node, winning) -> str:
    """Text of the winning lead with most votes that holds LEAST_OF_OWN of the page's own lead, with its parts; else what the page says by itself.

    winning has paths or their keys, those with more votes first; a dict from key to (place, parts) does too, where
    parts are the keys of what belongs to the article beside the lead, or None where too few pages were seen to judge: then a page
    whose own lead it is keeps all.
    """
    own = survey(root)
    place = winning if isinstance(winning, dict) else {k if isinstance(k, int) else path_key(k): (n, frozenset()) for n, k in reversed(list(enumerate(winning)))}
    found: dict[int, list[Node]] = {}
    if place:
        stack = [(root, 0)]
        while stack:
            node, key = stack.pop()
            if (node.tag in CONTAINERS or node is root) and key in place:
                found.setdefault(key, []).append(node)
            stack.extend((c, _next(key, c.step)) for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    least = LEAST_OF_OWN * own.inside[id(own.lead)] if own.lead else 0
    for key in sorted(found, key=lambda k: place[k][0]):
        leads, parts = found[key], place[key][1]
        if sum(own.inside[id(n)] for n in leads) < least or (own.lead and not sum(own.inside[id(n)] for n in leads)):
            continue
        held = blocks(own.whole) if parts is None and own.lead in leads else _chosen(leads, parts or frozenset())
        if held:
            return "\n".join(held)
    return "\n".join(blocks(own.whole)) if own.whole else ""


#: Bytes of all hosts' winning leads up to which every worker holds them all. Beyond it pages meet their host's leads
#: by a join, in which a host with more than a HOT-th of all pages (there are fewer than HOT of these) is dealt into parts of that size.
BROADCAST_BYTES, HOT = 8_000_000, 10_000
_HOST = r"^(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _places(leads) -> dict[int, tuple[int, frozenset | None]]:
    return {r["lead"] % (1 << 64): (n, None if r["parts"] is None else frozenset(k % (1 << 64) for k in r["parts"])) for n, r in enumerate(leads or ())}


def winners(pages: DataFrame) -> DataFrame:
    """host, all (its votes), leads for rows (host, html): a host's winning leads, those with most votes first, with the parts that belong to them.

    Different pages count, by the hash of their text, so copies of a page have one voice. Counts are partial aggregates; those of
    different texts are HyperLogLog sketches, the same whenever they are made.
    """

    def vote():
        def step(batch: pa.RecordBatch):
            rows = []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(name, signed(lead), None if part is None else signed(part), signed(seen), signed(text)) for lead, part, seen, text in ballot(parse(page.as_py() or ""))]
            return list(zip(*rows)) if rows else None

        return step

    votes = map_batches(pages.select("host", "html"), vote, "host string, lead long, part long, page long, text long")
    counted = checkpoint(votes.groupBy("host", "lead", "part").agg(F.count("*").alias("votes"), F.approx_count_distinct("page").alias("n_pages"), F.approx_count_distinct("text").alias("n_texts")))
    leads = counted.filter("part is null").select("host", "lead", "votes", "n_pages")
    with_lead = counted.filter("part is not null").join(leads.select("host", "lead", F.col("n_pages").alias("lead_pages")), ["host", "lead"])
    kept = with_lead.filter((F.col("n_pages") >= PART_SHARE * F.col("lead_pages")) & (F.col("n_texts") > REPEATED * F.col("n_pages")))
    parts = kept.groupBy("host", "lead").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    none = F.array().cast("array<bigint>")
    judged = leads.filter(F.col("votes") >= LEAST_VOTES).join(parts, ["host", "lead"], "left")
    judged = judged.withColumn("parts", F.when(F.col("n_pages") >= JUDGED, F.coalesce("parts", none)))
    total = leads.groupBy("host").agg(F.sum("votes").alias("all"))
    listed = judged.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_pages")).alias("n"), (-F.col("votes")).alias("v"), "lead", "parts"))).alias("leads"))
    return total.join(listed, "host", "left")


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's blocks in page order, joined by a newline; empty if there is none.

    Null or empty html is an empty page, a null or odd url belongs to the host ''. Rows with equal ids are extracted
    one by one, extra columns are ignored; no pages, no rows. Votes are counted with partial sums, so a hot host
    gathers no pages; equal votes go by the path's hash.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    won = checkpoint(winners(hosted))
    total = won.select("host", "all")
    won = won.filter(F.col("leads").isNotNull())
    schema = "page_id long, url string, text string, n_chars long"
    if (won.agg(F.sum(F.length("host") + F.aggregate("leads", F.lit(0), lambda n, x: n + 100 + 40 * F.greatest(F.size(x["parts"]), F.lit(0))))).first()[0] or 0) <= broadcast_bytes:
        known = pages.sparkSession.sparkContext.broadcast({r.host: _places(r.leads) for r in won.collect()})

        def again():
            places = known.value

            def step(batch: pa.RecordBatch):
                texts = [extract(parse(page.as_py() or ""), places.get(name, {})) for page, name in zip(batch.column(2), batch.column(3).to_pylist())]
                return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

            return step

        return map_batches(hosted, again, schema)
    one = (total.agg(F.sum("all")).first()[0] or 0) // HOT + 1
    parts = F.floor(F.col("all") / one).cast("int") + 1
    hot = total.filter(F.col("all") > one).select("host", parts.alias("parts"))  # fewer than HOT rows
    dealt = hosted.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("parts", F.lit(1))))
    spread = won.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("all") > one, parts - 1).otherwise(0)).cast("array<bigint>")))

    def joined_again():
        held: dict[str, dict] = {}

        def step(batch: pa.RecordBatch):
            texts = []
            for page, name, paths in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                if name not in held:
                    held.clear()
                    held[name] = _places(paths.as_py())
                texts.append(extract(parse(page.as_py() or ""), held[name]))
            return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

        return step

    met = dealt.join(spread, ["host", "part"], "left")
    return map_batches(met.select("page_id", "url", "html", "host", "leads"), joined_again, schema)
