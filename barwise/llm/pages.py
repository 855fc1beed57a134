"""Main text of HTML pages by composite text density.

A page becomes a tree of elements. For an element with C characters and T tags, of which LC and LT are in links, the
composite density is

    C / T * log(C / LC * T / LT)  to the base  ln(C / (C - LC) * LC + LCb / Cb * C + e)

with b for the body and counts of 0 taken as 1. The element whose children's densities sum to the most is the core of the
page. The smallest density on its path to the body is the threshold: from the core the extract grows up to the body, taking
in every neighbour but short notes on rights and those that are both less dense and mostly links; with an article or main element
around it, it is that element. A form goes unless it holds most of the page's text, as forms around whole pages do; its
labels and controls go all the same.

Time and memory are linear in the page, however broken or deeply nested it is.

Elements that are no text of the page by their kind, role or name (menus, page headers, footers, side bars, notices,
adverts, forms, scripts, comments by readers) do not count and are not shown, nor are lists that are mostly links outside
an article or main element.
"""

import html
import math
import re

#: a tag whose quoted attribute values may hold ">", and one that ends at the first ">"
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*(?:\"[^\"]*\"|'[^']*'))?)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an element that a start tag closes if it is open, and where the search for it ends
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "option": ("option", "select"), "thead": ("thead tbody tfoot", "table"),
          "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
AROUND_P = ("article aside body blockquote button div dd fieldset figure footer form header html li main nav object section table td th")
CLOSES["p"] = (frozenset(("p",)), frozenset(AROUND_P.split()))
_SCOPES = frozenset().union(*[a | b for a, b in CLOSES.values()])

# What is no part of the text.
DROPPED = frozenset(
    "annotation annotation-xml aside audio button canvas datalist dialog embed footer head iframe input map menu nav noembed noframes noscript "
    "object script select style svg template textarea title video xmp".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion "
    "related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: words that make a class or id one of layout, and words that add nothing to a name
LAYOUT = frozenset("has with without no left right".split())
PLAIN = frozenset("area bar block box button buttons container content form icon icons item items link links list main page post posts section site top bottom wrap wrapper".split())
#: what an article element may be instead of the article
OTHER_ARTICLES = frozenset("ad advert advertisement comment comments promo related replies reply respond sponsored".split())

_RIGHTS = re.compile(r"(©|\(c\)|copyright\b|all rights reserved)", re.I)


class Node:
    __slots__ = ("tag", "parts", "parent", "dropped", "named", "open", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag, parent, dropped=False, named=""):
        self.tag, self.parent, self.parts, self.dropped, self.named = tag, parent, [], dropped or bool(named), "" if dropped else named
        self.open = parent.open if parent is not None else {}
        if tag in _SCOPES:
            # for each kind of tag that closes another: the innermost element it would close from inside this one
            self.open = dict(self.open)
            for kind, (closed, until) in CLOSES.items():
                if tag in until:
                    self.open[kind] = None
                elif tag in closed:
                    self.open[kind] = self

    def children(self):
        return [p for p in self.parts if not isinstance(p, str)]


def _attributes(text):
    out = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _hidden(tag, found):
    """Whether attributes tell that the element is not shown or has another role."""
    if not found or tag in ("html", "body", "main"):
        return False
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    return False


def _name(tag, found):
    """``sure`` if a class or id is the name of what is no text, ``maybe`` if such a word stands beside other words
    (market-share), else nothing. Names of layout (has-sidebar) say nothing."""
    if not found or tag in ("html", "body", "main"):
        return ""
    away, out = OTHER_ARTICLES if tag == "article" else NAMES, ""
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if away.isdisjoint(words) or not LAYOUT.isdisjoint(words):
            continue
        if words <= away | PLAIN:
            return "sure"
        out = "maybe"
    return out


def tokens(source):
    """(text before, tag match or None, where the rest begins). Comments and declarations are no text. Every character is
    looked at a fixed number of times: past the last ">" nothing is a tag, and once a tag does not end outside quotes, no
    later one is read with quotes."""
    at = look = 0
    end, last, quotes = len(source), source.rfind(">"), True
    while True:
        start = source.find("<", look)
        if start < 0:
            break
        if source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            after = stop + 3 if stop >= 0 else end
        elif source[start + 1 : start + 2] in ("!", "?"):
            after = source.find(">", start) + 1 or end
        else:
            name = source[start + 1 : start + 3].removeprefix("/")[:1]
            if not (name.isascii() and name.isalpha()):
                look = start + 1
                continue
            if start > last:
                break
            match = _TAG.match(source, start) if quotes else None
            quotes = match is not None
            match = match or _PLAIN_TAG.match(source, start)
            at = look = yield source[at:start], match, match.end()
            continue
        yield source[at:start], None, after
        at = look = after
    yield source[at:], None, end


def parse(source):
    """The root of the page's tree; end tags may be missing, as HTML allows."""
    root = node = Node("#root", None)
    stack = {}  # how many elements of each kind are open
    stream, go = tokens(source), None

    def leave(until):
        """Close everything up to and with ``until``."""
        nonlocal node
        while node is not until:
            stack[node.tag] -= 1
            node = node.parent
        stack[node.tag] -= 1
        node = node.parent

    while True:
        try:
            text, match, after = stream.send(go)
        except StopIteration:
            return root
        go = after if match else None
        if text:
            node.parts.append(text)
        if not match:
            continue
        tag, closing, attributes = match[2].lower(), match[1], match[3]
        if closing:
            if stack.get(tag):
                open_ = node
                while open_.tag != tag:
                    open_ = open_.parent
                leave(open_)
            continue
        if tag in BLOCK and tag != "option" and node.open.get("p"):
            leave(node.open["p"])
        if tag in CLOSES and node.open.get(tag):
            leave(node.open[tag])
        found = _attributes(attributes) if attributes else {}
        child = Node(tag, node, tag in DROPPED or _hidden(tag, found), "sure" if tag == "form" else _name(tag, found))
        node.parts.append(child)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, after)
            go = stop.start() if stop else len(source)
            child.dropped = True
        if tag not in VOID and (tag in RAW or not attributes.rstrip().endswith("/") or tag in BLOCK):
            node = child
            stack[tag] = stack.get(tag, 0) + 1


def _ordered(root):
    """Nodes that count, parents first."""
    out = [root]
    for node in out:
        out += [c for c in node.children() if not c.dropped]
    return out


def _weigh_names(order):
    """A doubtful name drops an element only if most of its text is links; where no article or main element is left, no
    name drops an element with most of the page's text outside links. ``order``: all nodes, parents first."""
    if not any(n.named for n in order):
        return
    chars, links = {}, {}
    for node in reversed(order):
        gone = node.dropped and not node.named
        inside = [] if gone else node.children()
        own = 0 if gone else sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        chars[id(node)] = own + sum(chars[id(c)] for c in inside)
        links[id(node)] = chars[id(node)] if node.tag == "a" else sum(links[id(c)] for c in inside)
    for node in order:
        if node.named == "maybe" and 2 * links[id(node)] <= chars[id(node)]:
            node.dropped, node.named = False, ""
    lost, whole = {}, chars[id(order[0])] - links[id(order[0])]
    for node in order:
        lost[id(node)] = node.dropped or (node.parent is not None and lost[id(node.parent)])
    if not any(n.tag in ("article", "main") and not lost[id(n)] for n in order):
        for node in order:
            if node.named and 2 * (chars[id(node)] - links[id(node)]) > whole:
                node.dropped, node.named = False, ""


def _mark(root):
    """If every article or main element lies in something dropped, what holds one stays after all. A page header goes; the
    header of an article keeps its headings."""
    todo, order, lost = [root], [], {}
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children()
    _weigh_names(order)
    for node in order:
        lost[id(node)] = node.dropped or (node.parent is not None and lost[id(node.parent)])
    articles = [n for n in order if n.tag in ("article", "main")]
    if articles and all(lost[id(n)] for n in articles):
        seen = set()
        for node in articles:
            while node is not None and id(node) not in seen:
                seen.add(id(node))
                node.dropped = node.dropped and (node.tag in RAW or node.tag in ("head", "template"))
                node = node.parent
    holds = set()
    for node in reversed(order):
        if node.tag in ("article", "main") or any(id(c) in holds for c in node.children()):
            holds.add(id(node))
    inside, forms = {}, {}  # whether an element lies in an article, main or section; in a form that stays
    for node in order:
        up = node.parent
        inside[id(node)] = up is not None and (inside[id(up)] or up.tag in ("article", "main", "section"))
        forms[id(node)] = up is not None and (forms[id(up)] or up.tag == "form")
        if node.tag in ("label", "legend") and forms[id(node)]:
            node.dropped = True
        if node.tag == "header" and id(node) not in holds:
            if not inside[id(node)]:
                node.dropped = True
            else:
                for child in node.children():
                    child.dropped |= child.tag not in HEADINGS and child.tag not in ("div", "hgroup")


def _measure(nodes):
    for node in nodes:
        node.chars = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.tags = node.link_chars = node.link_tags = 0
        node.total = 0.0
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags


def _densities(nodes, body):
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = max(node.chars, 0), max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = c / t * max(math.log(c / lc * t / lt), 0.0) / math.log(base) if base > 1 + 1e-12 else c / t * max(math.log(c / lc * t / lt), 0.0)
        if node.parent is not None:
            node.parent.total += node.density


def _core(nodes, body):
    """The subtree that is the text."""
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        return body
    path, up = [], best
    while up is not None and up is not body.parent:
        path.append(up)
        up = up.parent
    threshold = min(n.density for n in path)
    for at, node in enumerate(path):
        if node.tag in ("article", "main"):
            return node
    node = best
    while node is not body and node.parent is not None:
        whole = node.tag not in BLOCK or node.tag in HEADINGS or node.tag in ("p", "li", "blockquote", "pre")
        if not whole:
            for other in node.parent.children():
                if other is node or other.dropped or not other.chars or other.tag in HEADINGS:
                    continue
                thin = other.density < threshold and 2 * other.link_chars > other.chars
                other.dropped = thin or (other.chars < 200 and bool(_RIGHTS.match(" ".join(_words(other)))))
        node = node.parent
    return node


def _words(node):
    """Texts inside, in order."""
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out += html.unescape(part).split()
        elif not part.dropped:
            todo += reversed(part.parts)
    return out


def _link_list(node):
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.link_tags >= 3 and node.link_chars > 0.7 * node.chars


def _blocks(core):
    """Texts of the blocks in page order."""
    out, current = [], []

    def end():
        text = " ".join(html.unescape("".join(current)).split())
        if text:
            out.append(text)
        current.clear()

    todo = [("in", core)]
    while todo:
        what, node = todo.pop()
        if what == "text":
            current.append(node)
            continue
        if what == "out":
            end()
            continue
        if node.dropped or (core.tag not in ("article", "main") and node is not core and _link_list(node)):
            if node.tag in BLOCK:
                end()
            continue
        if node.tag == "br":
            current.append(" ")
        if node.tag in BLOCK:
            end()
            todo.append(("out", node))
        todo += [("text", p) if isinstance(p, str) else ("in", p) for p in reversed(node.parts)]
    end()
    return out


def main_text(source):
    """The blocks of the page's main text, joined by line feeds."""
    if not source:
        return ""
    root = parse(source)
    _mark(root)
    nodes = _ordered(root)
    _measure(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    inside = nodes if body is root else _ordered(body)
    _densities(inside, body)
    return "\n".join(_blocks(_core(inside, body)))
