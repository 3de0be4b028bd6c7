"""Configuration files: small texts read on the driver into plain values, and written back."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from pathlib import Path

from ..catalog import Area, Attribute, Catalog, fold

#: Fixed words that switch something on.
ON = ("TRUE", "YES", "ON")
INDEX_KINDS = ("ALL", "EXACT", "CIDR", "SOUNDEX", "NONE")
TYPES = {"TEXT": "TEXT", "ID": "ID", "SEE-ALSO": "SEE-ALSO"}


def tagged(text: str) -> list[tuple[str, str]]:
    """(tag, value) of each line with a colon that is no comment, the tag in lower case."""
    out = []
    for line in text.splitlines():
        s = "".join(c for c in line if c == "\t" or c >= " ").strip()
        tag, colon, value = s.partition(":")
        if colon and not s.startswith("#"):
            out.append((tag.strip().lower(), value.strip()))
    return out


def blocks(text: str) -> list[list[tuple[str, str]]]:
    """Tagged lines in blocks parted by lines of three dashes; empty blocks are left out."""
    found: list[list[str]] = [[]]
    for line in text.splitlines():
        if line.strip().startswith("---"):
            found.append([])
        else:
            found[-1].append(line)
    return [b for b in (tagged("\n".join(x)) for x in found) if b]


def main_settings(text: str) -> dict[str, str]:
    """Settings of a main file; the last of a tag counts."""
    return dict(tagged(text))


def is_on(value: str) -> bool:
    return fold(value) in ON


def areas(text: str) -> list[Area]:
    """Authority areas of an area file; an area named twice with one type counts once, one without name not at all."""
    out: list[Area] = []
    for block in blocks(text):
        tags = dict(block)
        if tags.get("name"):
            guardians = tuple(v for t, v in block if t == "guardian")
            area = Area(tags["name"], tags.get("type", "master").lower(), tags.get("serial-number"), guardians)
            if not any(fold(a.name) == fold(area.name) and a.kind == area.kind for a in out):
                out.append(area)
    return out


def soa(text: str) -> dict[str, str]:
    """Start-of-authority data of an area."""
    return dict(tagged(text))


def classes(text: str) -> list[dict[str, str | list[str]]]:
    """Classes of a schema file: name, aliases, attribute file, folder, description, version, parse program."""
    out: list[dict[str, str | list[str]]] = []
    for block in blocks(text):
        tags = dict(block)
        if tags.get("name"):
            out.append(tags | {"alias": [v for t, v in block if t == "alias"]})
    return out


def attributes(text: str, class_name: str, ids: Mapping[str, int], next_id: int) -> list[Attribute]:
    """Attributes of an attribute file, numbered by ``ids`` (folded name to id) or on from ``next_id``; a block without name is left out, unknown index kinds are none, unknown types text."""
    out = []
    for block in blocks(text):
        tags = dict(block)
        name = tags.get("attribute")
        if not name:
            continue
        attr_id = ids.get(fold(name))
        if attr_id is None:
            attr_id, next_id = next_id, next_id + 1
        kind, typ = fold(tags.get("index", "NONE")), TYPES.get(fold(tags.get("type", "TEXT")), "TEXT")
        flags = {f"is_{f.replace('-', '_')}": is_on(tags.get(f"is-{f}", "")) for f in ("primary-key", "required", "repeatable", "multi-line", "hierarchical", "private")}
        # a key is required whether or not it says so
        flags["is_required"] |= flags["is_primary_key"]
        out.append(Attribute(class_name, attr_id, name, tuple(v for t, v in block if t == "attribute-alias"), kind if kind in INDEX_KINDS else "NONE", typ, format=tags.get("format"), **flags))
    return out


def read_catalog(folder: str, area_file: str) -> Catalog:
    """The catalog of a folder of text files: the area file names each area's schema file, that each class's attribute file."""
    base = Path(folder)
    text = (base / area_file).read_text()
    found: dict[tuple[str, int], Attribute] = {}
    ids: dict[str, int] = {}
    names: dict[str, str] = {}
    for block in blocks(text):
        schema = dict(block).get("schema-file")
        if not schema:
            continue
        for c in classes((base / schema).read_text()):
            name = str(c["name"]).lower()
            names |= {a: name for a in c["alias"]}
            for a in attributes((base / str(c["attributedef"])).read_text(), name, ids, max(ids.values(), default=6) + 1):
                ids.setdefault(fold(a.name), a.attr_id)
                found.setdefault((name, a.attr_id), a)
    return Catalog(tuple(found.values()), tuple(areas(text)), names)


def punts(text: str) -> list[str]:
    """Lines of an upward referral list; comments and blank lines are left out."""
    return [s for line in text.splitlines() if (s := line.strip()) and not s.startswith("#")]


def directives(text: str) -> dict[str, bool]:
    """Which statements are enabled, by name."""
    return {t: is_on(v) for t, v in tagged(text)}


def extended_directives(text: str) -> dict[str, dict[str, str]]:
    """Extension statements by command, with description and program."""
    return {dict(b)["command"].lower(): dict(b) for b in blocks(text) if "command" in dict(b)}


def host_lists(text: str) -> list[str]:
    """Patterns of a host list, what stands behind the first colon of a line, or all of it."""
    out = []
    for line in punts(text):
        _, colon, rest = line.partition(": ")
        out.append(rest.strip() if colon else line)
    return out


def settings_text(settings: Mapping[str, str]) -> str:
    """Settings as a main file has them."""
    return "".join(f"{k}: {v}\n" for k, v in settings.items())


def areas_text(found: Iterable[Area]) -> str:
    """Areas as an area file has them."""
    return "---\n".join("".join([f"type: {a.kind}\n", f"name: {a.name}\n", *(f"guardian: {g}\n" for g in a.guardians)]) for a in found)


def attributes_text(found: Iterable[Attribute]) -> str:
    """Attributes as an attribute file has them."""
    out = []
    for a in found:
        lines = [f"attribute: {a.name}", *(f"attribute-alias: {x}" for x in a.aliases), *([f"format: {a.format}"] if a.format else []), f"index: {a.index_kind}", f"type: {a.attr_type}"]
        lines += [f"is-{f}: {str(getattr(a, 'is_' + f.replace('-', '_'))).upper()}" for f in ("primary-key", "required", "repeatable", "multi-line", "hierarchical", "private")]
        out.append("\n".join(lines) + "\n")
    return "---\n".join(out)


def soa_text(data: Mapping[str, str]) -> str:
    """Start-of-authority data as its file has them."""
    return settings_text(data)


def write_all(files: Mapping[str, str], folder: str, suffix: str = ".new") -> None:
    """Writes texts to a folder in two phases: all under a suffix first, then each in its place, so that a failure leaves the old ones."""
    base = Path(folder)
    for name, text in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / (name + suffix)).write_text(text)
    for name in files:
        os.replace(base / (name + suffix), base / name)
