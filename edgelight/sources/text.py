"""Parsers of instrument files, as plain functions from text to records; the data sources and tests use them."""

from __future__ import annotations

import math
import re

from edgelight.constants import KTOE_FIT
from edgelight.functions.elements import atomic_number, mass_of

#: What counts as a number in a data row: no underscores, no exponent letter but e
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:inf|infinity|nan)", re.IGNORECASE | re.ASCII)
COMMENT = "#;%*!$"


def decoded(data: bytes) -> str:
    """UTF-8 if it is, else CP949 with replacement."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp949", "replace")


def numbers(line: str) -> list[float] | None:
    """The values of a data row, or None if any token is no number."""
    tokens = [t for t in re.split(r"[ \t,\r]+", line) if t]
    if not tokens or line.lstrip()[:1] in COMMENT or not all(NUMBER.fullmatch(t) for t in tokens):
        return None
    return [float(t) for t in tokens]


def labels_of(header: list[str], width: int) -> list[str]:
    """Column.N tags if all columns have one, else the last header line with as many tokens, else col1, col2, ..."""
    tags = {}
    for line in header:
        m = re.match(r"[#;%*!$\s]*Column\.(\d+)\s*:\s*(.*)", line, re.IGNORECASE)
        if m and m[2].split("||")[0].split():
            tags[int(m[1])] = m[2].split("||")[0].split()[0]
    if all(i in tags for i in range(1, width + 1)):
        return [tags[i] for i in range(1, width + 1)]
    for line in reversed(header):
        tokens = [t for t in re.split(r"[ \t,\r]+", line.strip().lstrip(COMMENT)) if t]
        if tokens:
            return tokens if len(tokens) == width else [f"col{i}" for i in range(1, width + 1)]
    return [f"col{i}" for i in range(1, width + 1)]


def column_file(text: str, skip: int | None = None) -> dict:
    """header, labels and columns. Data is the first unbroken run of numeric lines; short rows are dropped, long ones cut."""
    lines = text.splitlines()
    begin = min(skip or 0, len(lines))
    header, rows = lines[:begin], []
    for line in lines[begin:]:
        row = numbers(line)
        if row is not None:
            rows.append(row)
        elif rows and line.strip():
            break
        elif not rows:
            header.append(line)
    if not rows:
        raise ValueError("NoData")
    width = len(rows[0])
    rows = [r[:width] for r in rows if len(r) >= width]
    return {"header": header, "labels": labels_of(header, width), "columns": [list(c) for c in zip(*rows)]}


#: Names that give a column its role, whole ones first, then parts of names
ROLES = {
    "energy": (("energy", "e", "col1"), ("energy",)),
    "i0": (("i0", "io"), ("i0",)),
    "it": (("it", "itrans", "i1", "trans"), ("itrans", "trans")),
    "iflu": (("if", "iflu", "ifluor"), ("fluor", "fluo", "iff")),
    "iref": (("iref", "i2", "iref2"), ("iref",)),
    "mu": (("mu", "xmu", "mutrans", "norm"), ("mutrans", "xmu")),
}


def roles_of(labels: list[str]) -> dict[str, int | None]:
    low = [x.lower() for x in labels]
    out = {}
    for role, (whole, parts) in ROLES.items():
        named = [i for i, x in enumerate(low) if x in whole]
        like = [i for i, x in enumerate(low) if any(p in x for p in parts)]
        out[role] = (named or like or [None])[0]  # the first column in file order
    return out


def import_defaults(labels: list[str]) -> dict:
    """How to build mu from a file: raw if it has mu and no transmitted intensity, else transmission."""
    roles, last = roles_of(labels), max(len(labels) - 1, 0)
    if roles["mu"] is not None and roles["it"] is None:
        return {"mode": "raw", "energy": roles["energy"] or 0, "mu": roles["mu"]}
    pick = lambda role, at: min(at, last) if roles[role] is None else roles[role]
    return {"mode": "transmission", "energy": pick("energy", 0), "i0": pick("i0", 1), "it": pick("it", 2)}


def _float(text: str, default: float = 0.0) -> float:
    try:
        return float(text)
    except ValueError:
        return default


def path_file(text: str) -> dict:
    """A scattering-path file: scalars, potentials, geometry, seven columns and the two made from them."""
    out = {"title": "", "version": "", "shell": "K", "absorber": None, "gam_ch": 0.0, "exch": "", "vmu": 0.0, "vfermi": 0.0, "vint": 0.0, "rs_int": 0.0, "nleg": 0, "degen": 1.0, "reff": 0.0, "rnorman": 0.0, "edge": 0.0, "potentials": [], "geom": []}
    rows, part, seen = [], "header", 0
    for i, raw in enumerate(text.splitlines()):
        line = re.sub(r"^\s*#", "", raw).rstrip() if part != "data" else raw
        if i == 0:
            out["title"], out["version"] = line[:64].strip(), line[64:].strip()
        elif part == "header":
            words = line.replace("=", " ").split()
            if line.strip().startswith("----"):
                part = "path"
            elif re.match(r"\s*(Abs|Pot\s+\d+)\b.*\bZ\s*=", line):
                first = 2 if words[0] == "Pot" else 1
                rest = words[first:]
                out["potentials"].append({"ipot": int(words[1]) if first == 2 else 0, "iz": int(_float(rest[1])), "rmt": _float(rest[3]), "rnm": _float(rest[5])})
                if first == 1 and len(rest) > 6:
                    out["shell"] = rest[6]
            elif words[:1] == ["Gam_ch"]:
                out["gam_ch"], out["exch"] = _float(words[1]), " ".join(words[2:])
            elif words[:1] == ["Mu"]:
                v = line.replace("=", " ").replace("eV", " ").split()
                out["vmu"], out["vfermi"], out["vint"], out["rs_int"] = _float(v[1]), _float(v[3]) ** 2 * KTOE_FIT, _float(v[5]), _float(v[7])
        elif part == "path":
            seen += 1
            words = line.split()
            if words[:1] == ["k"] and "real[p]@#" in raw:
                part = "data"
            elif seen == 1:
                out["nleg"] = int(_float(words[0]))
                out["degen"], out["reff"], out["rnorman"], out["edge"] = map(_float, words[1:5])
            elif seen > 2 and len(words) >= 5:
                x, y, z = map(_float, words[:3])
                iz = int(_float(words[4]))
                label = words[5] if len(words) > 5 else f"Z{iz}"
                out["absorber"] = out["absorber"] or label
                out["geom"].append({"label": label, "iz": iz, "ipot": int(_float(words[3])), "mass": mass_of(iz) or 0.0, "x": x, "y": y, "z": z})
        else:
            values = raw.split()
            if len(values) == 7:
                rows.append([_float(v) for v in values])
    columns = [list(c) for c in zip(*rows)] or [[] for _ in range(7)]
    names = ("k", "real_phc", "mag_feff", "pha_feff", "red_fact", "lam", "rep")
    out.update(zip(names, columns))
    out["pha"] = [a + b for a, b in zip(out["real_phc"], out["pha_feff"])]
    out["amp"] = [a * b for a, b in zip(out["mag_feff"], out["red_fact"])]
    return out


EDGES = {1: "K", 2: "L1", 3: "L2", 4: "L3"}


def structure_input(text: str) -> dict:
    """TITLE, EDGE or HOLE, POTENTIALS and ATOMS of a structure input; an unknown card ends a section."""
    out = {"title": [], "edge": "K", "potentials": [], "atoms": []}
    section = None
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("*"):
            continue
        words = line.split()
        card = words[0].upper()
        if card == "TITLE":
            out["title"].append(line[5:].strip())
        elif card == "EDGE":
            out["edge"] = words[1].upper() if not words[1].isdigit() else EDGES.get(int(words[1]), "K")
        elif card == "HOLE":
            out["edge"] = EDGES.get(int(words[1]), "K")
        elif card in ("POTENTIALS", "ATOMS"):
            section = card
        elif card == "END":
            break
        elif card[0].isalpha():
            section = None
        elif section == "POTENTIALS":
            out["potentials"].append({"ipot": int(words[0]), "z": int(words[1]), "tag": words[2] if len(words) > 2 else ""})
        elif section == "ATOMS":
            try:
                x, y, z = map(float, words[:3])
                ipot = int(words[3])
            except (ValueError, IndexError) as e:
                raise ValueError(f"Parse: bad atom line {line!r}") from e
            out["atoms"].append({"x": x, "y": y, "z": z, "ipot": ipot, "tag": words[4] if len(words) > 4 else "", "distance": math.dist((0, 0, 0), (x, y, z))})
    return out


def result_blocks(text: str) -> list[dict]:
    """Blank-line separated curves with '# x-axis:', '# y-axis:' and '# curve N: label' lines."""
    blocks, axes = [], {"x": "", "y": ""}
    now = None
    for line in [*text.splitlines(), ""]:
        if m := re.match(r"#\s*([xy])-axis:\s*(.*)", line):
            axes[m[1]] = m[2].strip()
        elif m := re.match(r"#\s*curve\s+\d+:\s*(.*)", line):
            now = {"label": m[1].strip(), "x": [], "y": []}
        elif not line.strip():
            if now and now["x"]:
                blocks.append({**now, "x_label": axes["x"], "y_label": axes["y"]})
            now = None
        else:
            row = numbers(line)
            if row and len(row) >= 2:
                now = now or {"label": "", "x": [], "y": []}
                now["x"].append(row[0])
                now["y"].append(row[1])
    return blocks


#: Overlay kinds: suffix, value column, whether k-weighted
OVERLAYS = {"xmu": (1, False), "chi": (1, True), "rsp": (3, False), "qsp": (3, False), "bkg": (1, False), "norm": (1, False)}


def overlay(text: str, kind: str, kweight: int = 0) -> dict:
    """x and y of a file on an overlay graph."""
    at, weighted = OVERLAYS[kind]
    c = column_file(text)["columns"]
    y = c[min(at, len(c) - 1)]
    return {"x": c[0], "y": [v * k**kweight for k, v in zip(c[0], y)] if weighted else y}


def fit_input(text: str) -> dict:
    """guess and set variables, path entries, functions and settings of a fit input."""
    out = {"vars": [], "paths": {}, "functions": {}, "settings": {}, "nofit": False}
    for raw in text.splitlines():
        line = raw.strip()
        if m := re.match(r"%\s*set\s+(\w+)\s*=\s*(.+)", line, re.IGNORECASE):
            out["functions"][m[1]] = m[2].strip()
            continue
        line = line.split("%")[0].strip()
        if not line or line[0] in "#!*":
            continue
        words = line.replace("=", " ").split()
        key = words[0].lower()
        if key in ("guess", "set") and len(words) >= 3:
            out["vars"].append({"name": words[1], "vary": key == "guess", "text": " ".join(words[2:])})
        elif key in ("path", "e0", "delr", "s02", "sigma2", "third", "fourth", "ei") and len(words) >= 3 and words[1].isdigit():
            out["paths"].setdefault(int(words[1]), {})[key] = " ".join(words[2:])
        elif key == "nofit":
            out["nofit"] = True
        else:
            for name, value in re.findall(r"(\w+)\s*=\s*(\S+)", line):
                out["settings"][name.lower()] = value
    return out


def element_of(tag: str) -> int | None:
    return atomic_number(re.match(r"[A-Za-z]*", tag)[0])
