"""Parsing of one resolved topic or map; pure functions on strings.

External DTDs and entities are never loaded: the parser used does not fetch anything.
"""

from __future__ import annotations

import posixpath
import re
from xml.etree import ElementTree

# Tags of text-level elements, whose text stays even where it is reused.
INLINE = frozenset(
    "ph b i u tt sup sub cite q term keyword wintitle menucascade shortcut uicontrol filepath userinput systemoutput msgnum msgph "
    "varname apiname parmname option cmdname envvar codeph synph tm indexterm indextermref xref image data text numcharref textentity".split()
)
# The body element of each topic type.
BODY = {"concept": "conbody", "task": "taskbody", "reference": "refbody", "glossentry": "glossdef", "topic": "body"}

_SPACE = " \t\n\r\f\v"


def collapse(text: str) -> str:
    return re.sub(r"[ \t\n\r\f\v]+", " ", text).strip(_SPACE)


def words(value: str | None) -> list[str]:
    """An attribute's words; a blank but not empty attribute is one empty word."""
    return re.split(r"[ \t\n\r\f\v]+", value.strip(_SPACE)) if value else []


def resolve_path(base: str, href: str) -> str:
    """``href`` against the folder of ``base``; a base without a folder leaves it as it is."""
    folder = posixpath.dirname(base)
    return posixpath.normpath(f"{folder}/{href}") if folder else href


def is_external(href: str, scope: str | None) -> bool:
    return href.startswith(("http://", "https://")) or scope in ("external", "peer")


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[:dot] if dot > 0 else name


def _first_text(root, tag: str) -> str | None:
    for el in root.findall(tag):
        t = "".join(el.itertext()).strip(_SPACE)
        if t:
            return t
    return None


def foreign_marks(xml: bytes) -> list[str]:
    """All distinct source marks in a topic; which of them are other files is found by a join."""
    return sorted({el.get("xtrf") for el in ElementTree.fromstring(xml).iter() if el.get("xtrf")})


def parse_topic(path: str, xml: bytes, sources: dict[str, str]) -> dict:
    """A topic's record. ``sources``: the file of each source mark that is one of the job's topics."""
    root = ElementTree.fromstring(xml)
    kind = root.tag if root.tag in BODY else "topic"
    body_root = root.find(BODY[kind])
    text, foreign, controls, in_cmd = [], [], [], []
    links: dict[str, list[tuple[str, str]]] = {"xref": [], "link": []}

    # one walk in document order, on a stack of its own so that no depth of nesting is too much; an
    # element stands there with what it inherits, the text behind it as a string
    todo: list = [(root, False, False, False)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            text.append(item)
            continue
        el, inside, silent, cmd = item
        inside = inside or el is body_root
        origin = sources.get(el.get("xtrf") or "")
        if origin and origin != path:
            if origin not in foreign:
                foreign.append(origin)
            silent = silent or el.tag not in INLINE
        if el.tag == "uicontrol":
            name = collapse("".join(el.itertext()))
            for seen in [controls, in_cmd] if cmd else [controls]:
                if name and name not in seen:
                    seen.append(name)
        cmd = cmd or el.tag == "cmd"
        if el.tag in links:
            href = el.get("href") or ""
            target = href.split("#", 1)[0]
            if target and not is_external(href, el.get("scope")):
                links[el.tag].append(("requires" if el.get("keyref") else "references", resolve_path(path, target)))
        heard = inside and not silent
        if heard and el.text:
            text.append(el.text)
        for child in reversed(el):
            if heard and child.tail:
                todo.append(child.tail)
            if child.tag != "related-links":
                todo.append((child, inside, silent, cmd))

    own = root.get("id") or stem(path)
    short = root.find("shortdesc")
    shortdesc = "".join(short.itertext()).strip(_SPACE) if short is not None else ""
    return {
        "path": path,
        "root_tag": root.tag,
        "id": own,
        "topic_type": kind,
        "title": _first_text(root, "title") or own,
        "shortdesc": shortdesc or None,
        "body": collapse("".join(text)) or None,
        "audience": words(root.get("audience")),
        "product": words(root.get("product")),
        "uicontrols": controls,
        "cmd_uicontrols": in_cmd,
        "status": root.get("status"),
        "foreign": foreign,
        "links": links["xref"] + links["link"],
    }


def parse_map(path: str, xml: bytes) -> tuple[dict, list[dict]]:
    """(map record, rows). Rows: ``kind`` contains or navref, ``container`` (null: the map),
    ``target``, ``level``, ``keys``, in the order of the walk."""
    root = ElementTree.fromstring(xml)
    own = root.get("id") or stem(path)
    rows: list[dict] = []
    todo = [(child, None, 1) for child in reversed(list(root))]
    while todo:
        el, container, level = todo.pop()
        inner = None
        if el.tag == "navref":
            rows.append({"kind": "navref", "container": container, "target": el.get("mapref") or el.get("href") or "", "level": level, "keys": []})
        elif el.tag in ("topichead", "topicgroup"):
            inner = (container, level)
        elif el.tag == "topicref":
            href = el.get("href") or ""
            if not href or is_external(href, el.get("scope")):
                inner = (container, level)
            else:
                target = resolve_path(path, href)
                rows.append({"kind": "contains", "container": container, "target": target, "level": level, "keys": words(el.get("keys"))})
                inner = (target, level + 1)
        if inner:
            todo.extend((child, *inner) for child in reversed(list(el)))
    return {"id": own, "title": _first_text(root, "title") or own, "source_file": path}, rows
