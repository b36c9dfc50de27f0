"""Manifests and locks of five package managers as snapshots.

Each format has a reader that yields (name, fields); of several rows of a name the last counts. Files go through in
Arrow batches, one file at a time; a file that can't be read gives no rows.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # YAML locks then give no rows, like any file that can't be read
    yaml = None

Row = tuple[str, dict[str, Any]]
FIELDS = ("version", "source", "integrity", "ref")
NPM_SECTIONS = ("dependencies", "devDependencies", "optionalDependencies")
CARGO_SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")
_REQUIREMENT = re.compile(r"\s*([A-Za-z0-9._-]+)\s*(?:@\s*(\S+)|([<>=!~]=?[^;#\s]*)?)")


def _s(value: Any) -> str:
    return "" if value is None else str(value)


def _dict(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def _list(value: Any) -> list:
    return value if isinstance(value, list) else []


def _first(table: dict, *keys: str) -> str:
    return next((_s(table[k]) for k in keys if table.get(k)), "")


def npm_ref(spec: str) -> str:
    """What a repository address pins; HEAD where it names nothing, empty for what comes from a registry."""
    if not re.match(r"(?i)git\+|github:|gitlab:|bitbucket:", spec) and ".git" not in spec:
        return ""
    return spec.rsplit("#", 1)[1] if "#" in spec else "HEAD"


def python_ref(url: str) -> str:
    if "git" not in url.lower():
        return ""
    query = url.rsplit("?", 1)[1] if "?" in url else ""
    named = (re.search(rf"{k}=([^&]*)", query) for k in ("rev", "ref", "tag", "branch"))
    hit = next((m for m in named if m), None)
    return hit[1] if hit else url.rsplit("#", 1)[1] if "#" in url else ""


def python_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def descriptor_name(text: str) -> str:
    """The package of `name@range`; a scope keeps its @."""
    m = re.match(r'\s*"?(@?[^@"]*)', text)
    return m[1].strip() if m else ""


def npm_manifest(text: str) -> Iterator[Row]:
    data = _dict(json.loads(text))
    for section in NPM_SECTIONS:
        for name, spec in _dict(data.get(section)).items():
            remote = re.match(r"(?i)git\+|github:|gitlab:|bitbucket:", _s(spec)) or "://" in _s(spec)
            yield name, {"version": spec, "source": spec if remote else "", "direct": True, "ref": npm_ref(_s(spec))}


def npm_lock(text: str) -> Iterator[Row]:
    """Told apart by content: JSON, yarn's two forms, pnpm."""
    if text.lstrip().startswith("{"):
        yield from _package_lock(_dict(json.loads(text)))
    elif "__metadata:" in text or "\n  resolution:" in text:
        for key, entry in _dict(yaml.safe_load(text)).items():
            if key != "__metadata" and isinstance(entry, dict):
                at = _s(entry.get("resolution"))
                yield descriptor_name(_s(key).split(",")[0]), {"version": entry.get("version"), "source": at if "://" in at or "@git" in at else "", "integrity": entry.get("checksum"), "ref": npm_ref(at)}
    elif text.lstrip().startswith("lockfileVersion") or "\npackages:" in text:
        yield from _pnpm(_dict(yaml.safe_load(text)))
    else:
        yield from _yarn(text)


def _package_lock(data: dict) -> Iterator[Row]:
    entries = _dict(data.get("packages"))
    direct = {n for section in NPM_SECTIONS for n in _dict(_dict(entries.get("")).get(section))}
    late = {}
    for key, entry in entries.items():
        if key and isinstance(entry, dict):
            name = key.rsplit("node_modules/", 1)[-1]
            late[name] = {"version": entry.get("version"), "source": entry.get("resolved"), "integrity": entry.get("integrity"), "direct": name in direct, "ref": npm_ref(_s(entry.get("resolved")))}
    # Of nested copies the last counts; of the older form, which nests dependencies in each other, the first.
    seen = set(late)
    yield from late.items()
    stack = [(n, e, True) for n, e in reversed(_dict(data.get("dependencies")).items())]
    while stack:
        name, entry, is_direct = stack.pop()
        if not isinstance(entry, dict):
            continue
        if name not in seen:
            seen.add(name)
            yield name, {"version": entry.get("version"), "source": entry.get("resolved"), "integrity": entry.get("integrity"), "direct": is_direct, "ref": npm_ref(_s(entry.get("resolved")))}
        stack += [(n, e, False) for n, e in reversed(_dict(entry.get("dependencies")).items())]


def _pnpm(data: dict) -> Iterator[Row]:
    direct = {n for section in ("dependencies", "devDependencies") for n in _dict(data.get(section))}
    found = {}
    for key, entry in _dict(data.get("packages")).items():
        m = re.fullmatch(r"/*(@?[^@]+)@([^(]*)(?:\(.*)?|/*(.+)/([^/]*)", _s(key))
        name, version = (m[1] or m[3], m[2] if m[1] else m[4]) if m else (_s(key).lstrip("/"), "")
        at = _dict(_dict(entry).get("resolution"))
        found[name] = {"version": version, "source": _first(at, "tarball", "repo"), "integrity": at.get("integrity")}
    for name in {**found, **dict.fromkeys(direct)}:
        yield name, {**found.get(name, {}), "direct": name in direct}


def _yarn(text: str) -> Iterator[Row]:
    for block in re.split(r"\n(?=[^\s#])", f"\n{text}"):
        head, _, rest = block.lstrip("\n").partition("\n")
        if not re.match(r'"?[^\s,"#]+.*:\s*$', head):
            continue
        fields = dict(re.findall(r'(?m)^\s{2,}(version|resolved|integrity)\s+"?([^"\n]*?)"?\s*$', rest))
        at = fields.get("resolved", "")
        yield descriptor_name(head.rstrip(": \t").split(",")[0]), {"version": fields.get("version"), "source": at if "://" in at else "", "integrity": fields.get("integrity"), "ref": npm_ref(at)}


def _requirement(line: str) -> Iterator[Row]:
    if m := _REQUIREMENT.match(line):
        url = m[2] or ""
        yield python_name(m[1]), {"version": "" if url else m[3], "source": url, "direct": True, "ref": python_ref(url)}


def _poetry(block: Any) -> Iterator[Row]:
    for name, spec in _dict(block).items():
        if name != "python":
            table = spec if isinstance(spec, dict) else {"version": spec}
            yield python_name(name), {"version": table.get("version"), "source": _first(table, "git", "url", "path"), "direct": True, "ref": _first(table, "rev", "branch", "tag")}


def _pyproject(data: dict) -> Iterator[Row]:
    project, poetry = _dict(data.get("project")), _dict(_dict(data.get("tool")).get("poetry"))
    lists = [project.get("dependencies"), *_dict(project.get("optional-dependencies")).values(), *_dict(data.get("dependency-groups")).values()]
    for entry in (e for x in lists for e in _list(x) if isinstance(e, str)):
        yield from _requirement(entry)
    for block in (poetry.get("dependencies"), poetry.get("dev-dependencies"), *(_dict(g).get("dependencies") for g in _dict(poetry.get("group")).values())):
        yield from _poetry(block)


def python_manifest(text: str) -> Iterator[Row]:
    """A pyproject file, or requirements line by line; includes and options don't count."""
    if text.lstrip().startswith("[") or "\n[" in text:
        rows = list(_pyproject(tomllib.loads(text)))
        if rows:
            yield from rows
            return
    for line in (raw.split("#", 1)[0].strip() for raw in text.splitlines()):
        if line and not line.startswith("-"):
            yield from _requirement(line)


def python_lock(text: str) -> Iterator[Row]:
    for entry in _list(tomllib.loads(text).get("package")):
        entry = _dict(entry)
        if name := python_name(_s(entry.get("name"))):
            at = _dict(entry.get("source"))
            kind = next((k for k in ("registry", "git", "url", "path", "directory", "editable") if at.get(k)), "")
            source, ref = _s(at.get(kind)) if kind else "", ""
            if kind == "git":
                ref = python_ref(source)
            if at.get("reference") and (not kind or kind == "url"):
                source, ref = _s(at.get("url")), _s(at["reference"]) if not kind else ref
            hashes = [_dict(entry.get("sdist")), *_list(entry.get("wheels")), *_list(entry.get("files"))]
            yield name, {"version": entry.get("version"), "source": source, "integrity": next((_s(h["hash"]) for h in map(_dict, hashes) if h.get("hash")), ""), "ref": ref}


def go_manifest(text: str) -> Iterator[Row]:
    """require and replace, in blocks or alone and in either order: a replacement is the module's source."""
    found: dict[str, dict[str, Any]] = {}
    block = ""
    for raw in text.splitlines():
        line = raw.split("//", 1)[0].strip()
        if line == ")":
            block = ""
        elif m := re.fullmatch(r"(require|replace) \(", line):
            block = m[1]
        elif line:
            verb, rest = (block, line) if block else (line.split(None, 1) + [""])[:2]
            if verb == "replace" and (m := re.match(r"(\S+)(?:\s+\S+)?\s*=>\s*(\S+)", rest)):
                found.setdefault(m[1], {"direct": True})["source"] = m[2]
            elif verb == "require" and (m := re.match(r"(\S+)\s+(v\S+)", rest)):
                found.setdefault(m[1], {}).update(version=m[2], direct=not re.search(r"//.*\bindirect\b", raw))
    yield from found.items()


def go_lock(text: str) -> Iterator[Row]:
    """A module's own hash counts over that of its manifest."""
    found: dict[str, dict[str, Any]] = {}
    for path, version, digest in (p[:3] for p in map(str.split, text.splitlines()) if len(p) >= 3):
        if version.endswith("/go.mod"):
            found.setdefault(path, {"version": version.removesuffix("/go.mod")})
        else:
            found[path] = {"version": version, "integrity": digest}
    yield from found.items()


def cargo_manifest(text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    for table in (data, _dict(data.get("workspace"))):
        for section in CARGO_SECTIONS:
            for name, spec in _dict(table.get(section)).items():
                spec = spec if isinstance(spec, dict) else {"version": spec}
                yield name, {"version": spec.get("version"), "source": _first(spec, "git", "path", "registry"), "direct": True, "ref": _first(spec, "rev", "branch", "tag")}


def cargo_lock(text: str) -> Iterator[Row]:
    for entry in map(_dict, _list(tomllib.loads(text).get("package"))):
        at = _s(entry.get("source"))
        yield _s(entry.get("name")), {"version": entry.get("version"), "source": at, "integrity": entry.get("checksum"), "ref": at.rpartition("#")[2] if at.startswith("git+") else ""}


def composer_manifest(text: str) -> Iterator[Row]:
    data = _dict(json.loads(text))
    for section in ("require", "require-dev"):
        for name, spec in _dict(data.get(section)).items():
            if name != "php" and not name.startswith("ext-"):
                yield name, {"version": spec, "direct": True}
    if data.get("repositories"):
        yield "(composer repositories)", {"source": json.dumps(data["repositories"], sort_keys=True)[:200], "direct": True}


def composer_lock(text: str) -> Iterator[Row]:
    data = _dict(json.loads(text))
    for entry in (_dict(e) for section in ("packages", "packages-dev") for e in _list(data.get(section))):
        at, dist = _dict(entry.get("source")), _dict(entry.get("dist"))
        yield _s(entry.get("name")), {"version": entry.get("version"), "source": at.get("url") or dist.get("url"), "integrity": dist.get("shasum"), "ref": at.get("reference") if at.get("type") == "git" else ""}


READERS = {
    ("npm", "manifest"): npm_manifest, ("npm", "lock"): npm_lock, ("python", "manifest"): python_manifest, ("python", "lock"): python_lock, ("go", "manifest"): go_manifest,
    ("go", "lock"): go_lock, ("cargo", "manifest"): cargo_manifest, ("cargo", "lock"): cargo_lock, ("composer", "manifest"): composer_manifest, ("composer", "lock"): composer_lock,
}
FILES = {
    "package.json": ("npm", "manifest"), "package-lock.json": ("npm", "lock"), "npm-shrinkwrap.json": ("npm", "lock"), "yarn.lock": ("npm", "lock"), "pnpm-lock.yaml": ("npm", "lock"),
    "pyproject.toml": ("python", "manifest"), "uv.lock": ("python", "lock"), "poetry.lock": ("python", "lock"), "pdm.lock": ("python", "lock"), "go.mod": ("go", "manifest"), "go.sum": ("go", "lock"),
    "Cargo.toml": ("cargo", "manifest"), "Cargo.lock": ("cargo", "lock"), "composer.json": ("composer", "manifest"), "composer.lock": ("composer", "lock"),
}


def reader_of(path: str) -> tuple[str, str] | None:
    base = path.rsplit("/", 1)[-1]
    return FILES.get(base) or (("python", "manifest") if base.startswith("requirements") and base.endswith(".txt") else None)


def read(path: str, text: str) -> dict[str, dict[str, Any]]:
    """A file's packages by name, the last row of a name; none of a file that can't be read or isn't one of these."""
    which = reader_of(path)
    if which is None:
        return {}
    try:
        return {name: fields for name, fields in READERS[which](text) if name}
    except Exception:  # a file's form isn't ours to guarantee, and one bad file must not end a job
        return {}


def snapshot(files: DataFrame, path: str = "path", text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """(keep..., ecosystem, dir, part, name, version, source, integrity, direct, ref) of the packages of all files, part being manifest or lock."""
    keep = list(keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, at = [], []
            for i, (p, t) in enumerate(zip(part.column(path).to_pylist(), part.column(text).to_pylist(), strict=True)):
                which = reader_of(p or "")
                for name, f in read(p or "", t or "").items():
                    rows.append((which[0], p.rpartition("/")[0], which[1], name, *(_s(f.get(k)) for k in ("version", "source", "integrity")), bool(f.get("direct")), _s(f.get("ref"))))
                    at.append(i)
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [pa.string()] * 7 + [pa.bool_(), pa.string()]
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c).take(taken) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], keep + NAMES)

    kept = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    schema = "ecosystem string, dir string, part string, name string, version string, source string, integrity string, direct boolean, ref string"
    return files.select(*keep, path, text).where(F.col(path).isNotNull()).mapInArrow(run, f"{kept}, {schema}" if keep else schema)


NAMES = ["ecosystem", "dir", "part", "name", "version", "source", "integrity", "direct", "ref"]
