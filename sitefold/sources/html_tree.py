"""How a browser reads HTML: tokens, then the insertion modes of the HTML standard as a stack of open elements.

No tree is kept. ``Reader`` holds the open elements, the formatting elements to open again, and for each open element the text
node at its end, so that words count per text node as in the tree: text around an ignored tag is one node, text around an
element or a comment two; text in a table belongs before it.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

# Element names of the HTML standard.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_IN_HEAD = frozenset(("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"))
_VOID = frozenset(("area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"))
_RAW = frozenset(("iframe", "noembed", "noframes", "noscript", "script", "style", "textarea", "title", "xmp"))
_FORMATTING = frozenset(("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"))
_BLOCKS = frozenset(
    ("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing").split()
)
_IMPLIED = frozenset(("dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc"))
_MARKED = frozenset(("applet", "marquee", "object"))
_TABLE_PARTS = frozenset(("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"))
_SECTIONS = frozenset(("tbody", "tfoot", "thead"))
_FOSTERING = _SECTIONS | {"table", "tr"}
_SCOPE = _MARKED | {"caption", "html", "table", "td", "th", "template"}
_TABLE_SCOPE = frozenset(("html", "table", "template"))
_SPECIAL = _BLOCKS | _IN_HEAD | HEADINGS | _MARKED | _TABLE_PARTS | frozenset(
    ("area body br button dd dt embed form frame frameset head hr html iframe img input keygen li noembed noscript param plaintext select source table textarea track wbr xmp").split()
)
_BREAKOUT = frozenset(
    ("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var").split()
)
_TEXT_POINTS = frozenset((("math", "mi"), ("math", "mo"), ("math", "mn"), ("math", "ms"), ("math", "mtext")))
_HTML_POINTS = frozenset((("svg", "foreignobject"), ("svg", "desc"), ("svg", "title")))
#: Elements whose text is not content.
SKIPPED = frozenset(("script", "style", "template", "noscript"))

_SPACE = "\t\n\f\r "
_TAG = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*(?:(=?[^\t\n\f\r />=]+|=)(?:[\t\n\f\r ]*=[\t\n\f\r ]*("[^"]*"|'[^']*'|[^\t\n\f\r >"'][^\t\n\f\r >]*|(?=>)))?)?""")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]+;?)(=?)")
_SCRIPT_STEP = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I)


def _value(text: str) -> str:
    """References of an attribute: a name without semicolon counts only where no letter, digit or ``=`` follows."""
    known = lambda m: m[1][0] == "#" or m[1] in html5 and (m[1][-1] == ";" or not m[2])
    return _REFERENCE.sub(lambda m: unescape(f"&{m[1]}") + m[2] if known(m) else m[0], text) if "&" in text else text


class _Open:
    """An open element: its text node at the end, for a table that before it, and how many skipped elements hold it."""

    __slots__ = ("name", "space", "tail", "before", "attrs", "skips", "point", "in_p")

    def __init__(self, name, space="", attrs=None, skips=0, before=None, parent=None):
        self.name, self.space, self.attrs, self.skips, self.before = name, space, attrs or {}, skips, before
        self.tail = None
        #: 1 takes text and most start tags as HTML, 2 all start tags
        self.point = 1 if (space, name) in _TEXT_POINTS else 2 if (space, name) in _HTML_POINTS or (space == "math" and name == "annotation-xml" and self.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")) else 0
        #: whether a paragraph would be closed here; known at once, however deep the element is
        ends = self.point if space else name in _SCOPE or name == "button"
        self.in_p = not space and name == "p" or not ends and parent is not None and parent.in_p


class Reader:
    """Elements that were made, in order, as ``elements (name, attributes)``, and the words of the body."""

    def __init__(self, html: str):
        self.html, self.at = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""), 0
        self.elements: list[tuple[str, dict[str, str]]] = []
        self.texts: list[tuple[list[str], int]] = []
        self.open: list[_Open] = []
        #: formatting elements to open again; None is a marker
        self.active: list[_Open | None] = []
        self.templates: list = []
        self.mode = self._start
        self.body = self.form = self.head = None
        self.framesets = True
        self.fostering = False
        self._tokens()

    @property
    def words(self) -> int:
        """Words of the body's text nodes, less those in skipped elements, once for each of them."""
        return max(0, sum(len("".join(parts).split()) * (1 - skips) for parts, skips in self.texts))

    # Tokens.

    def _tokens(self):
        html, n = self.html, len(self.html)
        while self.at < n:
            start = html.find("<", self.at)
            if start < 0:
                start = n
            # a "<" that opens nothing is text
            while start < n and not (html.startswith(("!", "?"), start + 1) or _TAG.match(html, start + 1) or html.startswith("/", start + 1) and start + 2 < n):
                start = html.find("<", start + 1)
                start = n if start < 0 else start
            if start > self.at:
                text, self.at = html[self.at : start], start
                self._text(unescape(text) if "&" in text else text)
            if self.at < n:
                self._markup()

    def _markup(self):
        html, at = self.html, self.at
        closing = html.startswith("/", at + 1)
        tag = _TAG.match(html, at + 1 + closing)
        if tag is None:
            self._comment()
            return
        name, pos, attrs, n = tag[0].lower(), tag.end(), {}, len(html)
        while True:
            m = _ATTRIBUTE.match(html, pos)
            pos = m.end()
            if m[1] is None:
                break
            value = m[2]
            if value is None and html.startswith("=", self._past_space(pos)):
                pos = n  # a quote that never closes: the tag is lost with the rest
                break
            key = m[1].lower()
            if key not in attrs and value is not None and value[:1] in ('"', "'"):
                value = value[1:-1]
            attrs.setdefault(key, _value(value or ""))
        if pos >= n or html[pos] != ">":
            self.at = n
            return
        self.at = pos + 1
        if closing:
            self._end(name)
        else:
            self._begin(name, attrs, html[pos - 1] == "/" and m[0].endswith("/"))

    def _past_space(self, pos: int) -> int:
        while self.html[pos : pos + 1] and self.html[pos] in _SPACE:
            pos += 1
        return pos

    def _comment(self):
        html, at = self.html, self.at
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                self.at = html.index(">", at) + 1
            else:
                end = _COMMENT_END.search(html, at + 4)
                self.at = end.end() if end else len(html)
        elif html.startswith("<![CDATA[", at) and self.open and self.open[-1].space:
            end = html.find("]]>", at)
            end = len(html) if end < 0 else end
            text, self.at = html[at + 9 : end], end + 3
            self._text(text)
            return
        else:
            end = html.find(">", at)
            self.at = len(html) if end < 0 else end + 1
            if html.startswith("</>", at) or html[at : at + 9].lower() == "<!doctype":
                return
        if self.mode not in (self._start, self._before_head, self._after_body):
            self._made_child()

    def _raw_text(self, name: str) -> str:
        """Text up to the end tag of a raw element. A script within a comment of a script doesn't end it."""
        html, begin, pos, double, comment = self.html, self.at, self.at, False, False
        if name == "script":
            for m in _SCRIPT_STEP.finditer(html, begin):
                if m[0] == "<!--":
                    comment = True
                elif m[0] == "-->":
                    comment = double = False
                elif m[1] and not double:
                    pos = m.start()
                    break
                else:
                    double = not m[1] and comment
            else:
                pos = len(html)
        else:
            m = re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I).search(html, begin)
            pos = m.start() if m else len(html)
        end = html.find(">", pos)
        self.at = len(html) if end < 0 else end + 1
        return html[begin:pos]

    # The stack.

    def _place(self):
        """The element that gets the next node, and whether the node goes before that (a table) instead of into it."""
        current = self.open[-1]
        if self.fostering and current.name in _FOSTERING and not current.space:
            for entry in reversed(self.open):
                if entry.name == "template" and not entry.space:
                    return entry, False
                if entry.name == "table" and not entry.space:
                    return entry, True
            return self.open[0], False
        return current, False

    def _made_child(self):
        """A node that isn't text ends the text node where it goes."""
        entry, before = self._place()
        if before:
            entry.before = None
        else:
            entry.tail = None

    def _add_text(self, text: str):
        entry, before = self._place()
        node = entry.before if before else entry.tail
        if node is None:
            node = []
            # text before a table has the skipped elements that hold the table
            if self.body is not None and self.body in self.open:
                self.texts.append((node, entry.skips))
            if before:
                entry.before = node
            else:
                entry.tail = node
        node.append(text)

    def _push(self, name: str, attrs=None, space: str = "", made: bool = True) -> _Open:
        skips, before = 0, None
        if self.open:
            entry, fostered = self._place()
            skips, before = entry.skips, entry.before if fostered else entry.tail
            self._made_child()
        if made:
            self.elements.append((name, attrs or {}))
        element = _Open(name, space, attrs, skips + (name in SKIPPED), before, self.open[-1] if self.open else None)
        self.open.append(element)
        return element

    def _leaf(self, name, attrs):
        self._push(name, attrs)
        self.open.pop()

    def _raw(self, name, attrs):
        self._push(name, attrs)
        text = self._raw_text(name)
        fostering, self.fostering = self.fostering, False
        if text:
            self._add_text(unescape(text) if name in ("title", "textarea") else text)
        self.fostering = fostering
        self.open.pop()

    def _in_scope(self, names, limits=_SCOPE) -> bool:
        for e in reversed(self.open):
            if not e.space and e.name in names:
                return True
            if e.name in limits if not e.space else e.point and limits is not _TABLE_SCOPE:
                return False
        return False

    def _pop_until(self, names):
        while self.open:
            e = self.open.pop()
            if not e.space and e.name in names:
                return

    def _pop_to(self, names):
        while self.open[-1].space or self.open[-1].name not in names:
            self.open.pop()

    def _implied(self, but: str = ""):
        while self.open[-1].name in _IMPLIED and self.open[-1].name != but and not self.open[-1].space:
            self.open.pop()

    def _close_p(self):
        if self.open[-1].in_p:
            self._implied("p")
            self._pop_until(("p",))

    def _forget(self):
        """Formatting elements up to the last marker are not opened again."""
        while self.active and self.active.pop() is not None:
            pass

    def _is_open(self, element: _Open) -> bool:
        return any(e is element for e in reversed(self.open))

    def _reopen(self):
        first = len(self.active)
        while first and self.active[first - 1] is not None and not self._is_open(self.active[first - 1]):
            first -= 1
        for k in range(first, len(self.active)):
            self.active[k] = self._push(self.active[k].name, self.active[k].attrs, made=False)

    def _activate(self, element: _Open):
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                break
            if self.active[k].name == element.name and self.active[k].attrs == element.attrs:
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(element)

    def _formatting(self, name: str):
        found = None
        for e in reversed(self.active):
            if e is None:
                break
            if e.name == name:
                found = e
                break
        return found

    def _adopt(self, name: str):
        """End of a formatting element: blocks that it holds stay open, with a copy of it inside."""
        if self.open[-1].name == name and not self.open[-1].space and self.open[-1] not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            element = self._formatting(name)
            if element is None:
                self._end_other(name)
                return
            if element not in self.open:
                self.active.remove(element)
                return
            if not self._in_scope((name,)):
                return
            depth = self.open.index(element)
            block = next((k for k in range(depth + 1, len(self.open)) if self.open[k].name in _SPECIAL and not self.open[k].space or self.open[k].point), None)
            if block is None:
                del self.open[depth:]
                self.active.remove(element)
                return
            furthest, mark = self.open[block], self.active.index(element)
            between, kept = self.open[depth + 1 : block], []
            for k, node in enumerate(reversed(between), 1):
                if node in self.active and k > 3:
                    mark -= self.active.index(node) < mark
                    self.active.remove(node)
                elif node in self.active:
                    copy = _Open(node.name, "", node.attrs, node.skips, None, self.open[depth - 1])
                    if not kept:
                        mark = self.active.index(node) + 1
                    self.active[self.active.index(node)] = copy
                    kept.insert(0, copy)
            # what the block holds moves into the copy; the block moves to the parent of the element
            copy = _Open(name, "", element.attrs, furthest.skips, None, furthest)
            copy.tail, furthest.tail = furthest.tail, None
            if self.open[depth - 1].name in _FOSTERING:
                table = next((e for e in reversed(self.open[:depth]) if e.name == "table"), None)
                if table is not None:
                    table.before = None
            self.open[depth - 1].tail = None
            mark -= self.active.index(element) < mark
            self.active.remove(element)
            self.active.insert(mark, copy)
            self.open[depth : block + 1] = [*kept, furthest, copy]

    def _end_other(self, name: str):
        for k in range(len(self.open) - 1, 0, -1):
            e = self.open[k]
            if e.name == name and not e.space:
                self._implied(name)
                del self.open[k:]
                return
            if e.name in _SPECIAL and not e.space or e.point:
                return

    def _reset(self):
        """The mode that the open elements ask for."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].name if not self.open[k].space else ""
            if name == "template":
                self.mode = self.templates[-1]
                return
            if name in self._modes():
                self.mode = self._modes()[name]
                return
        self.mode = self._after_head if self.body is None else self._in_body

    def _modes(self):
        return {
            "select": self._in_select, "td": self._in_cell, "th": self._in_cell, "tr": self._in_row, "tbody": self._in_section, "thead": self._in_section, "tfoot": self._in_section, "caption": self._in_caption,
            "colgroup": self._in_columns, "table": self._in_table, "head": self._in_head, "body": self._in_body, "frameset": self._in_frameset,
        }

    # Tokens go to the mode, those in svg and math to _foreign. A mode gets (kind, data, attributes, whether "/" ends the tag).

    def _text(self, text: str):
        current = self.open[-1] if self.open else None
        if current is not None and current.space and not current.point:
            self._add_text(text)
            return
        # leading space and the rest differ before a body
        head = text[: len(text) - len(text.lstrip(_SPACE))]
        if self.mode in (self._start, self._before_head, self._in_head, self._after_head, self._after_body, self._in_columns, self._in_frameset):
            if head:
                self.mode("space", head, {}, False)
            if len(head) < len(text):
                self.mode("text", text[len(head) :], {}, False)
        else:
            self.mode("text" if len(head) < len(text) else "space", text, {}, False)

    def _begin(self, name, attrs, closed):
        current = self.open[-1] if self.open else None
        html_point = current is not None and (current.point == 2 or current.point == 1 and name not in ("mglyph", "malignmark") or (current.space, current.name) == ("math", "annotation-xml") and name == "svg")
        if current is not None and current.space and not html_point:
            if name in _BREAKOUT or name == "font" and {"color", "face", "size"} & attrs.keys():
                while self.open[-1].space and not self.open[-1].point:
                    self.open.pop()
                self.mode("start", name, attrs, closed)
                return
            self._push(name, attrs, current.space)
            if closed:
                self.open.pop()
            return
        self.mode("start", name, attrs, closed)

    def _end(self, name):
        if self.open and self.open[-1].space:
            if name in ("br", "p"):
                while self.open[-1].space and not self.open[-1].point:
                    self.open.pop()
            else:
                for k in range(len(self.open) - 1, 0, -1):
                    if not self.open[k].space:
                        break
                    if self.open[k].name == name:
                        del self.open[k:]
                        return
        self.mode("end", name, {}, False)

    def _start(self, kind, data, attrs, closed):
        if kind == "space" or kind == "end" and data not in ("head", "body", "html", "br"):
            return
        self._push("html", attrs if (kind, data) == ("start", "html") else {})
        self.mode = self._before_head
        if (kind, data) != ("start", "html"):
            self.mode(kind, data, attrs, closed)

    def _before_head(self, kind, data, attrs, closed):
        if kind == "space" or (kind, data) == ("start", "html") or kind == "end" and data not in ("head", "body", "html", "br"):
            return
        self.head = self._push("head")
        self.mode = self._in_head
        if (kind, data) != ("start", "head"):
            self.mode(kind, data, attrs, closed)

    def _in_head(self, kind, data, attrs, closed):
        if kind == "space":
            self._add_text(data)
        elif kind == "start" and (data in _IN_HEAD or data == "noscript"):
            self._meta(data, attrs)
        elif (kind, data) == ("end", "template"):
            self._end_template()
        elif (kind, data) in (("start", "html"), ("start", "head")) or kind == "end" and data not in ("head", "body", "html", "br"):
            return
        else:
            self.open.pop()
            self.mode = self._after_head
            if (kind, data) != ("end", "head"):
                self.mode(kind, data, attrs, closed)

    def _meta(self, name, attrs):
        if name == "template":
            self._push(name, attrs)
            self.active.append(None)
            self.framesets = False
            self.templates.append(self._in_template)
            self.mode = self._in_template
        elif name in _RAW:
            self._raw(name, attrs)
        else:
            self._leaf(name, attrs)

    def _end_template(self):
        if any(e.name == "template" and not e.space for e in self.open):
            self._pop_until(("template",))
            self._forget()
            self.templates.pop()
            self._reset()

    def _after_head(self, kind, data, attrs, closed):
        if kind == "space":
            self._add_text(data)
        elif kind == "start" and data in _IN_HEAD:
            self.open.append(self.head)
            self._meta(data, attrs)
            self.open.remove(self.head)
        elif (kind, data) == ("end", "template"):
            self._end_template()
        elif (kind, data) in (("start", "html"), ("start", "head")) or kind == "end" and data not in ("body", "html", "br"):
            return
        elif (kind, data) == ("start", "frameset"):
            self._push("frameset", attrs)
            self.mode = self._in_frameset
        else:
            self.body = self._push("body", attrs if data == "body" else {})
            self.framesets = self.framesets and (kind, data) != ("start", "body")
            self.mode = self._in_body
            if (kind, data) != ("start", "body"):
                self.mode(kind, data, attrs, closed)

    def _in_body(self, kind, data, attrs, closed):
        if kind in ("text", "space"):
            self._reopen()
            self._add_text(data)
            self.framesets = self.framesets and kind == "space"
        elif kind == "start":
            self._body_start(data, attrs, closed)
        else:
            self._body_end(data)

    def _body_start(self, name, attrs, closed):
        if name in _IN_HEAD:
            self._meta(name, attrs)
        elif name in ("html", "body"):
            self.framesets = self.framesets and name == "html"
        elif name == "frameset":
            if self.framesets and len(self.open) > 1 and self.open[1] is self.body:
                del self.open[1:]
                self.texts, self.body = [], None
                self._push(name, attrs)
                self.mode = self._in_frameset
        elif name in _BLOCKS or name in HEADINGS:
            self._close_p()
            if name in HEADINGS and self.open[-1].name in HEADINGS:
                self.open.pop()
            self._push(name, attrs)
            self.framesets = self.framesets and name not in ("pre", "listing")
        elif name == "form":
            inside = any(e.name == "template" for e in self.open)
            if self.form is None or inside:
                self._close_p()
                form = self._push(name, attrs)
                self.form = self.form if inside else form
        elif name in ("li", "dd", "dt"):
            self.framesets = False
            alike = ("li",) if name == "li" else ("dd", "dt")
            for e in reversed(self.open):
                if not e.space and e.name in alike:
                    self._implied(e.name)
                    self._pop_until((e.name,))
                    break
                if (e.name in _SPECIAL and not e.space or e.point) and e.name not in ("address", "div", "p"):
                    break
            self._close_p()
            self._push(name, attrs)
        elif name == "plaintext":
            self._close_p()
            self._push(name, attrs)
            text, self.at = self.html[self.at :], len(self.html)
            self._add_text(text)
        elif name in _FORMATTING:
            if name == "a" and (old := self._formatting("a")) is not None:
                self._adopt("a")
                self.active = [e for e in self.active if e is not old]
                self.open = [e for e in self.open if e is not old]
            self._reopen()
            if name == "nobr" and self._in_scope(("nobr",)):
                self._adopt("nobr")
                self._reopen()
            self._activate(self._push(name, attrs))
        elif name in _MARKED:
            self._reopen()
            self._push(name, attrs)
            self.active.append(None)
            self.framesets = False
        elif name == "table":
            self._close_p()
            self._push(name, attrs)
            self.framesets = False
            self.mode = self._in_table
        elif name == "hr":
            self._close_p()
            self._leaf(name, attrs)
            self.framesets = False
        elif name in _RAW:  # title, style and script are of the head
            if name == "xmp":
                self._close_p()
                self._reopen()
            self.framesets = self.framesets and name in ("noembed", "noscript")
            self._raw(name, attrs)
        elif name in _TABLE_PARTS or name in ("frame", "head"):
            return
        elif name in _VOID or name == "image":
            if name not in ("param", "source", "track"):
                self._reopen()
                self.framesets = self.framesets and name == "input" and attrs.get("type", "").lower() == "hidden"
            self._leaf("img" if name == "image" else name, attrs)
        elif name == "select":
            self._reopen()
            self._push(name, attrs)
            self.framesets = False
            self.mode = self._in_select
        elif name in ("rb", "rp", "rt", "rtc"):
            if self._in_scope(("ruby",)):
                self._implied("rtc" if name in ("rp", "rt") else "")
            self._push(name, attrs)
        else:
            if name == "button":
                if self._in_scope(("button",)):
                    self._implied()
                    self._pop_until(("button",))
                self.framesets = False
            elif name in ("optgroup", "option") and self.open[-1].name == "option":
                self.open.pop()
            self._reopen()
            self._push(name, attrs, name if name in ("math", "svg") else "")
            if closed and name in ("math", "svg"):
                self.open.pop()

    def _body_end(self, name):
        if name == "template":
            self._end_template()
        elif name in ("body", "html"):
            if self._in_scope(("body",)):
                self.mode = self._after_body
        elif name == "p":
            if not self.open[-1].in_p:
                self._push("p")
            self._close_p()
        elif name == "form" and not any(e.name == "template" for e in self.open):
            form, self.form = self.form, None
            if form in self.open and self._in_scope(("form",)):
                self._implied()
                self.open.remove(form)
        elif name in _BLOCKS or name in _MARKED or name in ("button", "form", "li", "dd", "dt"):
            if self._in_scope((name,), _SCOPE | {"ol", "ul"} if name == "li" else _SCOPE):
                self._implied(name)
                self._pop_until((name,))
                if name in _MARKED:
                    self._forget()
        elif name in HEADINGS:
            if self._in_scope(HEADINGS):
                self._implied()
                self._pop_until(HEADINGS)
        elif name in _FORMATTING:
            self._adopt(name)
        elif name == "br":
            self._body_start("br", {}, False)
        else:
            self._end_other(name)

    def _fostered(self, kind, data, attrs, closed):
        self.fostering = True
        self._in_body(kind, data, attrs, closed)
        self.fostering = False

    def _in_table(self, kind, data, attrs, closed):
        if kind == "space" and self.open[-1].name in _FOSTERING:
            self._add_text(data)
        elif kind == "start" and data in _TABLE_PARTS:
            self._pop_to(_TABLE_SCOPE)
            if data == "caption":
                self.active.append(None)
            made = data if data in _SECTIONS or data in ("caption", "colgroup") else "colgroup" if data == "col" else "tbody"
            self._push(made, attrs if made == data else {})
            self.mode = self._modes()[made]
            if made != data:
                self.mode(kind, data, attrs, closed)
        elif data == "table" and kind in ("start", "end"):
            if self._in_scope(("table",), _TABLE_SCOPE):
                self._pop_until(("table",))
                self._reset()
                if kind == "start":
                    self.mode(kind, data, attrs, closed)
        elif kind == "end" and (data in _TABLE_PARTS or data in ("body", "html")):
            return
        elif kind == "start" and data in ("style", "script", "template") or (kind, data) == ("end", "template"):
            self._meta(data, attrs) if kind == "start" else self._end_template()
        elif kind == "start" and data == "input" and attrs.get("type", "").lower() == "hidden":
            self._leaf(data, attrs)
        elif kind == "start" and data == "form":
            if self.form is None and not any(e.name == "template" for e in self.open):
                self.form = self._push(data, attrs)
                self.open.pop()
        else:
            self._fostered(kind, data, attrs, closed)

    def _in_caption(self, kind, data, attrs, closed):
        leaves = kind == "start" and data in _TABLE_PARTS or kind == "end" and data in ("caption", "table")
        if leaves:
            if self._in_scope(("caption",), _TABLE_SCOPE):
                self._pop_until(("caption",))
                self._forget()
                self.mode = self._in_table
                if (kind, data) != ("end", "caption"):
                    self.mode(kind, data, attrs, closed)
        elif kind != "end" or data not in _TABLE_PARTS and data not in ("body", "html"):
            self._in_body(kind, data, attrs, closed)

    def _in_columns(self, kind, data, attrs, closed):
        if kind == "space":
            self._add_text(data)
        elif (kind, data) == ("start", "col"):
            self._leaf(data, attrs)
        elif data == "template" and kind in ("start", "end"):
            self._meta(data, attrs) if kind == "start" else self._end_template()
        elif self.open[-1].name == "colgroup" and (kind, data) not in (("start", "html"), ("end", "col")):
            self.open.pop()
            self.mode = self._in_table
            if (kind, data) != ("end", "colgroup"):
                self.mode(kind, data, attrs, closed)

    def _in_section(self, kind, data, attrs, closed):
        if kind == "start" and data in ("tr", "td", "th"):
            self._pop_to(_SECTIONS | {"html", "template"})
            self._push("tr", attrs if data == "tr" else {})
            self.mode = self._in_row
            if data != "tr":
                self.mode(kind, data, attrs, closed)
        elif kind == "end" and data in _SECTIONS:
            if self._in_scope((data,), _TABLE_SCOPE):
                self._pop_to(_SECTIONS | {"html", "template"})
                self.open.pop()
                self.mode = self._in_table
        elif kind == "start" and data in _TABLE_PARTS or (kind, data) == ("end", "table"):
            if self._in_scope(_SECTIONS, _TABLE_SCOPE):
                self._pop_to(_SECTIONS | {"html", "template"})
                self.open.pop()
                self.mode = self._in_table
                self.mode(kind, data, attrs, closed)
        else:
            self._in_table(kind, data, attrs, closed)

    def _in_row(self, kind, data, attrs, closed):
        leaves = kind == "start" and data in _TABLE_PARTS or kind == "end" and (data in ("table", "tr") or data in _SECTIONS)
        if kind == "start" and data in ("td", "th"):
            self._pop_to(("tr", "html", "template"))
            self._push(data, attrs)
            self.active.append(None)
            self.mode = self._in_cell
        elif leaves:
            if self._in_scope(("tr",), _TABLE_SCOPE) and (data not in _SECTIONS or kind == "start" or self._in_scope((data,), _TABLE_SCOPE)):
                self._pop_to(("tr", "html", "template"))
                self.open.pop()
                self.mode = self._in_section
                if (kind, data) != ("end", "tr"):
                    self.mode(kind, data, attrs, closed)
        else:
            self._in_table(kind, data, attrs, closed)

    def _in_cell(self, kind, data, attrs, closed):
        if kind == "end" and data in ("td", "th"):
            if self._in_scope((data,), _TABLE_SCOPE):
                self._implied()
                self._pop_until((data,))
                self._forget()
                self.mode = self._in_row
        elif kind == "start" and data in _TABLE_PARTS or kind == "end" and data in _FOSTERING:
            if self._in_scope(("td", "th") if kind == "start" else (data,), _TABLE_SCOPE):
                self._implied()
                self._pop_until(("td", "th"))
                self._forget()
                self.mode = self._in_row
                self.mode(kind, data, attrs, closed)
        elif kind != "end" or data not in ("body", "caption", "col", "colgroup", "html"):
            self._in_body(kind, data, attrs, closed)

    def _in_select(self, kind, data, attrs, closed):
        in_table = any(e.name == "table" for e in self.open) and data in _FOSTERING | {"caption", "td", "th"} and kind in ("start", "end")
        if in_table:
            if kind == "start" or self._in_scope((data,), _TABLE_SCOPE):
                self._pop_until(("select",))
                self._reset()
                self.mode(kind, data, attrs, closed)
        elif kind in ("text", "space"):
            self._add_text(data)
        elif kind == "start" and data in ("option", "optgroup", "hr"):
            for name in ("option", "optgroup")[: 1 + (data != "option")]:
                if self.open[-1].name == name:
                    self.open.pop()
            self._leaf(data, attrs) if data == "hr" else self._push(data, attrs)
        elif kind == "end" and data in ("option", "optgroup"):
            if data == "optgroup" and self.open[-1].name == "option" and self.open[-2].name == "optgroup":
                self.open.pop()
            if self.open[-1].name == data:
                self.open.pop()
        elif data == "select" or kind == "start" and data in ("input", "keygen", "textarea"):
            if any(e.name == "select" for e in self.open):
                self._pop_until(("select",))
                self._reset()
                if data != "select":
                    self.mode(kind, data, attrs, closed)
        elif kind == "start" and data in ("script", "template") or (kind, data) == ("end", "template"):
            self._meta(data, attrs) if kind == "start" else self._end_template()

    def _in_template(self, kind, data, attrs, closed):
        if kind == "start" and data not in _IN_HEAD:
            mode = self._in_columns if data == "col" else self._in_section if data == "tr" else self._in_row if data in ("td", "th") else self._in_table if data in _TABLE_PARTS else self._in_body
            self.templates[-1] = self.mode = mode
            self.mode(kind, data, attrs, closed)
        elif kind == "start":
            self._meta(data, attrs)
        elif kind != "end":
            self._in_body(kind, data, attrs, closed)
        elif data == "template":
            self._end_template()

    def _after_body(self, kind, data, attrs, closed):
        if kind == "space" or (kind, data) == ("start", "html"):
            self._in_body(kind, data, attrs, closed)
        elif (kind, data) != ("end", "html"):
            self.mode = self._in_body
            self.mode(kind, data, attrs, closed)

    def _in_frameset(self, kind, data, attrs, closed):
        """Text of frames is no text of a body."""
        if (kind, data) == ("start", "frameset"):
            self._push(data, attrs)
        elif (kind, data) == ("start", "frame"):
            self._leaf(data, attrs)
        elif (kind, data) == ("start", "noframes"):
            self._raw(data, attrs)
        elif (kind, data) == ("end", "frameset") and len(self.open) > 1:
            self.open.pop()
