"""Pages of a rebuilt document: items measured in lines and tokens, cut where they are too large, and laid out evenly."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import accumulate

from .folds import MORE, Section, goes_on
from .packing import by_tokens, split_table, split_text, tokens
from .text import CHARS_PER_TOKEN

# Fixed values of the printed page.
LINES_PER_PAGE, CHARS_PER_LINE, POINTS_PER_LINE = 42, 88, 14
HEADING_PT, TITLE_PT, BODY_PT = (20.0, 17.0, 15.0, 13.5, 12.5, 11.5), 24.0, 10.5
CONTINUED = "(tiếp)"
LEAST_TOKENS, LEAST_LINES, CUTS = 40, 6, 5
NO_LIMIT = 10**9
EDGE = " :.-–"


@dataclass(frozen=True)
class Item:
    """A heading, paragraph, table or figure of a page."""

    kind: str
    text: str
    level: int = 0
    size: float = BODY_PT
    height: float = 0.0
    width: float = 0.0
    caption: str = ""

    @cached_property
    def lines(self) -> int:
        if self.kind == "figure":
            return max(2, math.ceil(self.height / POINTS_PER_LINE) + 1) if self.height else 3
        written = self.text.split("\n")
        if self.kind == "table":
            return 1 + sum(max(1, math.ceil(len(r) / CHARS_PER_LINE)) for r in written if r.strip())
        wide = CHARS_PER_LINE * BODY_PT / self.size
        return sum(max(1, math.ceil(len(r) / wide)) for r in written) + (self.kind == "heading")

    @cached_property
    def tokens(self) -> int:
        return tokens(self.caption if self.kind == "figure" else self.text)

    def within(self, lines: int, most: int) -> bool:
        return self.lines <= lines and self.tokens <= most


@dataclass(frozen=True)
class Placed:
    """An item and where it stands: page, section (by position), part of the section."""

    page: int
    section: int
    part: int
    parts: int
    item: Item


def heading_size(level: int) -> float:
    return TITLE_PT if level <= 0 else HEADING_PT[min(level, len(HEADING_PT)) - 1]


def title_and_rest(s: Section) -> tuple[str, str]:
    """The printed name of a section, and the text that runs on behind it on the heading's line."""
    open_end = lambda x: x[:-1].strip(" +") if x.endswith(MORE) else x
    full = s.heading_text.strip()
    name = open_end(f"{s.number} {s.display_title or s.title}".strip())
    first, _, below = full.partition("\n")
    if not name:
        return first.strip(), below.strip()
    if full.startswith(name):
        return name, full[len(name) :].lstrip(EDGE + "\n")
    body = first.strip()
    # a joined section prints a joined name: its own number and title are taken off its heading's line
    own = s.number.split(" + ")[0].strip()
    for lead in (own, open_end(s.own_title.strip())):
        if lead and body.startswith(lead):
            body = body[len(lead) :].lstrip(EDGE)
    return name, "\n".join(x for x in (body, below.strip()) if x)


def heading_of(s: Section) -> Item | None:
    return None if s.is_preamble or not s.heading_text else Item("heading", title_and_rest(s)[0], s.level, heading_size(s.level))


def reopened(head: Item) -> Item:
    """The heading of a later part of the same section."""
    return replace(head, text=f"{head.text} {CONTINUED}")


def content_of(s: Section, drop_cover: bool) -> list[Item]:
    """A section's items: paragraphs that go on are one, figures of the first page go with the cover."""
    rest = title_and_rest(s)[1] if s.heading_text and not s.is_preamble else ""
    out = [Item("para", rest)] if rest else []
    for b in s.blocks:
        if b.kind == "figure":
            if not (drop_cover and b.page <= 1):
                f = b.figure or {}
                out.append(Item("figure", b.text, height=float(f.get("height") or 0), width=float(f.get("width") or 0), caption=f.get("caption") or ""))
        elif b.is_table or b.kind == "table":
            out.append(Item("table", b.text))
        elif b.text.strip():
            if out and out[-1].kind == "para" and goes_on(out[-1].text, b.text):
                out[-1] = replace(out[-1], text=f"{out[-1].text} {b.text}")
            else:
                out.append(Item("para", b.text))
    return out


def cut(item: Item, lines: int, most: int) -> list[Item]:
    """An item in parts within both ceilings; figures shrink. The limit halves a few times, as parts are measured in lines too."""
    if item.within(lines, most):
        return [item]
    if item.kind == "figure":
        scale = max(0.1, (lines - 1) / item.lines)
        return [replace(item, height=item.height * scale, width=item.width * scale)] if item.height else [item]
    table = item.kind == "table"
    limit = max(LEAST_TOKENS, min(most, math.ceil(lines * CHARS_PER_LINE / CHARS_PER_TOKEN)))
    parts = [item]
    for halved in range(CUTS):
        texts = (split_table if table else split_text)(item.text, limit >> halved, by_tokens)
        parts = [Item("table" if table and t.lstrip().startswith("|") else "para", t, size=item.size) for t in texts]
        if all(p.within(lines, most) for p in parts):
            break
    return parts


def stretches(lines: list[int], spent: list[int], room: int, most: int) -> Iterator[slice]:
    """Greedy stretches within both ceilings, one item at least, from prefix sums (that begin with 0)."""
    first, n = 0, len(lines) - 1
    while first < n:
        last = min(bisect_right(lines, lines[first] + room), bisect_right(spent, spent[first] + most)) - 1
        last = max(last, first + 1)
        yield slice(first, last)
        first = last


def evenly(items: list[Item], room: int, most: int) -> list[list[Item]]:
    """The fewest parts within both ceilings, at the lowest share of these (10 to 100 %) that needs no more parts."""
    lines, spent = ([0, *accumulate(x)] for x in ([i.lines for i in items], [i.tokens for i in items]))
    if lines[-1] <= room and spent[-1] <= most:
        return [items]
    count = lambda share: sum(1 for _ in stretches(lines, spent, room * share // 100, most * share // 100))
    need = count(100)
    share = 10 + bisect_left(range(10, 100), True, key=lambda p: count(p) <= need)
    return [items[s] for s in stretches(lines, spent, max(1, room * share // 100), max(1, most * share // 100))]


def flow(sections: list[Section], lines: int, most: int, drop_cover: bool) -> Iterator[Placed]:
    """One flow; sections above the ceiling of tokens reopen under their heading. The printer breaks the pages."""
    for at, s in enumerate(sections):
        head = heading_of(s)
        budget = most if most > 0 else NO_LIMIT
        if head is not None:
            budget = max(LEAST_TOKENS, budget - reopened(head).tokens)
        items = [p for i in content_of(s, drop_cover) for p in cut(i, lines, budget)]
        parts = [items] if head is None else evenly(items, NO_LIMIT, budget)
        for k, part in enumerate(parts):
            lead = [] if head is None else [reopened(head) if k else head]
            yield from (Placed(1, at, k + 1, len(parts), i) for i in lead + part)


def paged(sections: list[Section], lines: int, most: int, drop_cover: bool) -> Iterator[Placed]:
    """Pages of one section each. Headings without content wait for the first section below them; else they have a page each."""
    waiting: list[tuple[int, Section, Item]] = []
    page = 0
    for at, s in enumerate(sections):
        head, items = heading_of(s), content_of(s, drop_cover)
        if not items:
            waiting += [] if head is None else [(at, s, head)]
            continue
        below = lambda up: len(s.path) > len(up.path) and s.path[: len(up.path)] == up.path  # noqa: B023, E731
        keep = len(waiting)
        while keep and below(waiting[keep - 1][1]):
            keep -= 1
        for k, _, alone in waiting[:keep]:
            page += 1
            yield Placed(page, k, 1, 1, alone)
        lead = [h for _, _, h in waiting[keep:]] + ([] if head is None else [head])
        waiting = []
        again = Item("heading", "", s.level, heading_size(s.level)) if head is None else reopened(head)
        room = max(LEAST_LINES, lines - max(sum(i.lines for i in lead), again.lines))
        left = max(LEAST_TOKENS, most - max(sum(i.tokens for i in lead), again.tokens))
        parts = evenly([p for i in items for p in cut(i, room, left)], room, left)
        for k, part in enumerate(parts):
            page += 1
            above = lead if k == 0 else [] if head is None else [again]
            yield from (Placed(page, at, k + 1, len(parts), i) for i in above + part)
    for k, _, alone in waiting:
        page += 1
        yield Placed(page, k, 1, 1, alone)


def laid_out(sections: list[Section], lines: int = LINES_PER_PAGE, most: int = 512, drop_cover: bool = True, by_section: bool = False, title: str = "") -> list[Placed]:
    """All items of a document in order; its title opens the first page, if there is one."""
    out = list((paged if by_section else flow)(sections, lines, most, drop_cover))
    shown = title and (out or (sections and not by_section))
    return ([Placed(1, 0, 1, 1, Item("heading", title, 0, TITLE_PT))] if shown else []) + out
