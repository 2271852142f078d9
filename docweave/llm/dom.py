"""A small page reader: block elements as a tree, and their texts in page order, with what a template needs to know of both."""

from __future__ import annotations

import html
import re

#: Elements that begin a block of their own, that have no end tag, whose content is no markup, and those that are never part of a text.
BLOCKS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp template".split())
UNREAD = frozenset("button select option optgroup label legend svg math object canvas audio video datalist meter progress output map".split())
ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"hr"}
#: Blocks that the start of another ends, and the elements beyond which it does not reach.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
IMPLIED |= {t: ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("tbody", "thead", "tfoot")}
FENCES = frozenset(("table", "td", "th", "caption"))
#: Repeated elements of these kinds are one place of a template; other elements are places of their own, the first SAME of a kind.
REPEATED = frozenset("p li tr td th dt dd h2 h3 h4 h5 h6 blockquote pre figure".split())
SAME = 8
#: Elements nested deeper stand in the deepest one.
DEEPEST = 200

#: Names in class, id and role that pages give to what is not the article.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline-share consent cookie cookies footer gdpr header hidden login masthead menu menubar modal nav navbar navigation navigate newsletter notice notices "
    "outbrain overlay pagination pager paywall popup promo promotion promoted recommend recommended recommendations related rail search share sharing shares sidebar sidenav signup site-footer site-header skip social sponsor sponsored sponsors subscribe subscription taboola teaser teasers toolbar topbar widget widgets alert alertdialog complementary contentinfo".split()
)
REPLIES = frozenset("comment comments commentlist disqus replies reply respond responses".split())
CHROME_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "menu", "search", "fieldset"))

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


class Page:
    """Elements (block elements; 0 is the body) and texts (element, text, code points within links), both in page order."""

    __slots__ = ("tag", "parent", "label", "marks", "texts")

    def __init__(self):
        self.tag, self.parent, self.label, self.marks = ["body"], [-1], ["body"], [frozenset()]
        self.texts: list[tuple[int, str, int]] = []


def _marks(attributes: str) -> tuple[str, frozenset]:
    """What tells elements of one kind apart (class, else id, without figures), and the names that class, id and role hold."""
    first, names = {}, set()
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in first:
            continue
        first[name] = value
        if name in ("class", "id", "role"):
            names.update(w.lower() for w in _WORD.findall(value))
        elif name == "itemprop":
            names.add(f"@{value.lower()}")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            names.add("hidden")
    kind = re.sub(r"[^a-z.-]+", "", ".".join(sorted((first.get("class") or first.get("id") or "").lower().split())))
    return kind[:60], frozenset(names)


def parse(source: str) -> Page:
    """Read a page of any kind: unclosed elements end where a browser ends them, stray end tags are passed over, nothing raises."""
    page = Page()
    tag, parent, label, marks, texts = page.tag, page.parent, page.label, page.marks, page.texts
    stack, open_ = ["body"], [0]  # open block elements: names, and numbers
    unread: list[str] = []  # open elements without text
    beyond: dict[str, int] = {}
    buffer: list[str] = []
    linked, in_link = 0, False
    at, end = 0, len(source)

    def flush():
        nonlocal linked
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                texts.append((open_[-1], text, min(linked, len(text))))
        linked = 0

    def close(i: int):
        del stack[i:], open_[i:]

    def find(names, fences) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i] in names:
                return i
            if stack[i] in fences:
                return 0
        return 0

    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            piece, at = source[at:], end
        else:
            piece, at = source[at : m.start()], m.end()
        if piece and not unread:
            buffer.append(piece)
            if in_link:
                linked += len(piece)
        if m is None or m[2] is None:
            continue
        name, ending = m[2].lower(), bool(m[1])
        if name == "a":
            in_link = not ending
        elif name in BLOCKS:
            if unread:
                if name in CHROME_TAGS or name in ("main", "article", "section"):
                    unread.clear()  # never closed
                else:
                    continue
            flush()
            if not ending:
                if name in ENDS_P and (i := find(("p",), FENCES)):
                    close(i)
                if name in IMPLIED:
                    ends, fences = IMPLIED[name]
                    while i := find(ends, fences):
                        close(i)
                elif name[0] == "h" and stack[-1] == name and len(name) == 2:
                    close(len(stack) - 1)
                if len(stack) > DEEPEST:
                    beyond[name] = beyond.get(name, 0) + 1
                    continue
                kind, names = _marks(m[3]) if m[3] else ("", frozenset())
                tag.append(name)
                parent.append(open_[-1])
                label.append(f"{name}.{kind}" if kind else name)
                marks.append(names)
                stack.append(name)
                open_.append(len(tag) - 1)
            elif beyond.get(name):
                beyond[name] -= 1
            elif i := find((name,), FENCES - {name} if name not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {name}):
                close(i)
        elif name == "br":
            buffer.append(" ")
        elif name == "hr":
            flush()
            if i := find(("p",), FENCES):
                close(i)
        elif name in RAW:
            if not ending:
                found = _RAW_END[name].search(source, at)
                at = found.start() if found else end
        elif name in UNREAD:
            if ending:
                if name in unread:
                    del unread[len(unread) - 1 - unread[::-1].index(name) :]
            elif not m[3].rstrip().endswith("/"):
                unread.append(name)
            else:
                continue
    flush()
    return page


def places(page: Page) -> tuple[list[int], list[str], list[int]]:
    """The template's view of a page: each element's place, and the places' labels and parents. Repeated elements of one kind share a place."""
    of, label, parent = [0], [page.label[0]], [-1]
    children: list[list[int]] = [[]]
    last: list[int] = [-1]  # for every element: which of its place's children came last
    for e in range(1, len(page.tag)):
        up, name = page.parent[e], page.label[e]
        own, i = children[of[up]], last[up]
        found = -1
        if page.tag[e] in REPEATED:
            if i >= 0 and label[own[i]] == name:
                found = i
            else:
                found = next((j for j in range(i + 1, len(own)) if label[own[j]] == name), -1)
                if found < 0:
                    found = next((j for j in range(min(i + 1, len(own))) if label[own[j]] == name), -1)
        else:
            found = next((j for j in range(i + 1, len(own)) if label[own[j]] == name), -1)
            if found < 0:
                same = [j for j in range(len(own)) if label[own[j]] == name]
                if len(same) >= SAME:
                    found = same[-1]
        if found < 0:
            found = i + 1
            own.insert(found, len(label))
            label.append(name)
            parent.append(of[up])
            children.append([])
        of.append(own[found])
        last[up] = found
        last.append(-1)
    # numbered anew in the order of the page
    number, order, ahead = [0] * len(label), [], [0]
    while ahead:
        i = ahead.pop()
        number[i] = len(order)
        order.append(i)
        ahead.extend(reversed(children[i]))
    return [number[x] for x in of], [label[i] for i in order], [number[parent[i]] if i else -1 for i in order]


def shape(label: list[str], parent: list[int]) -> str:
    """Labels and parents of places as one text; equal trees give equal texts."""
    return " ".join(f"{p}:{x}" for p, x in zip(parent, label))


def tree(text: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of a shape."""
    label, children = [], []
    for part in text.split(" "):
        p, _, x = part.partition(":")
        label.append(x)
        children.append([])
        if int(p) >= 0:
            children[int(p)].append(len(label) - 1)
    return label, children


#: Products of children up to which two places are aligned in order by dynamic programming; wider ones pair the nth child of a kind with the nth of that kind.
WIDEST = 10_000


def align(a: str, b: str) -> tuple[int, list[int]]:
    """Simple tree matching: the largest number of places of two shapes that can be matched with parents and order kept, and for each place of ``a`` its partner in ``b`` (-1: none)."""
    la, ca = tree(a)
    lb, cb = tree(b)
    partner = [-1] * len(la)
    if a == b:
        return len(la), list(range(len(la)))
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def score(i: int, j: int) -> int:
        if la[i] != lb[j]:
            return 0
        if (i, j) in memo:
            return memo[i, j][0]
        x, y = ca[i], cb[j]
        chosen = []
        total = 0
        if x and y:
            if len(x) * len(y) > WIDEST:
                seen: dict[str, list[int]] = {}
                for v in y:
                    seen.setdefault(lb[v], []).append(v)
                used: dict[str, int] = {}
                for u in x:
                    n = used.get(la[u], 0)
                    if n < len(seen.get(la[u], ())):
                        used[la[u]] = n + 1
                        chosen.append((u, seen[la[u]][n]))
                total = sum(score(u, v) for u, v in chosen)
            else:
                best = [[0] * (len(y) + 1)]
                for u in x:
                    above, row = best[-1], [0]
                    for k, v in enumerate(y):
                        row.append(max(above[k + 1], row[k], above[k] + score(u, v) if la[u] == lb[v] else 0))
                    best.append(row)
                total = best[-1][-1]
                r, k = len(x), len(y)
                while r and k:
                    if best[r][k] == best[r - 1][k]:
                        r -= 1
                    elif best[r][k] == best[r][k - 1]:
                        k -= 1
                    else:
                        chosen.append((x[r - 1], y[k - 1]))
                        r, k = r - 1, k - 1
        memo[i, j] = (total + 1, chosen)
        return total + 1

    total = score(0, 0)
    ahead = [(0, 0)] if total else []
    while ahead:
        i, j = ahead.pop()
        partner[i] = j
        ahead.extend(memo[i, j][1])
    return total, partner
