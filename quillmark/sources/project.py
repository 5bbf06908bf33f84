"""Build metadata of a project folder: a handful of small files, read on the driver."""

from __future__ import annotations

import json
import os
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field


@dataclass(frozen=True)
class BuildInfo:
    build: str = ""
    jdk: str = ""
    module: str = ""
    entrypoints: tuple[str, ...] = ()
    globs: tuple[str, ...] = field(default=())


def jdk_number(version: str) -> str:
    v = version.strip()
    return v[2:] if v.startswith("1.") and len(v) > 2 else re.match("[0-9]*", v)[0]


def first_filled(*values: str | None) -> str:
    return next((v.strip() for v in values if v and v.strip()), "")


def _read(root: str, *names: str) -> str | None:
    for n in names:
        try:
            with open(os.path.join(root, n), encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            continue
    return None


def maven(root: str) -> BuildInfo | None:
    text = _read(root, "pom.xml")
    if text is None:
        return None
    try:
        tree = ET.fromstring(text)
    except ET.ParseError:
        return None
    for e in tree.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else e.tag
    get = lambda p: tree.findtext(p)
    jdk = first_filled(get("properties/maven.compiler.release"), get("properties/maven.compiler.target"), get("properties/maven.compiler.source"), get("properties/java.version"))
    return BuildInfo("maven", jdk_number(jdk) if jdk else "", first_filled(get("artifactId"), os.path.basename(os.path.abspath(root))), (), ("src/main/java/**/*.java",))


def gradle(root: str) -> BuildInfo | None:
    text = _read(root, "build.gradle", "build.gradle.kts")
    if text is None:
        return None
    jdk = ""
    m = re.search(r"""(?:source|target)Compatibility\s*=?\s*["']?(\d{1,2})["']?""", text) or re.search(r"(?:source|target)Compatibility\s*=?\s*JavaVersion\.VERSION_([0-9_]+)", text)
    if m:
        jdk = jdk_number(m[1].replace("_", "."))
    else:
        props = dict(x.split("=", 1) for x in (_read(root, "gradle.properties") or "").splitlines() if "=" in x and not x.lstrip().startswith("#"))
        props = {k.strip(): v.strip() for k, v in props.items()}
        jdk = jdk_number(first_filled(*(props.get(k) for k in ("org.gradle.java.home", "java.version", "jdk")))) if props else ""
    name = re.search(r"""rootProject\.name\s*=\s*["']([^"']+)["']""", _read(root, "settings.gradle", "settings.gradle.kts") or "")
    return BuildInfo("gradle", jdk, name[1] if name else os.path.basename(os.path.abspath(root)), (), ("src/main/java/**/*.java",))


def golang(root: str) -> BuildInfo | None:
    text = _read(root, "go.mod")
    if text is None:
        return None
    last = lambda word: ([x.split(None, 1)[1].strip() for x in map(str.strip, text.splitlines()) if x.startswith(word + " ")] or [""])[-1]
    return BuildInfo("go", last("go"), first_filled(last("module"), os.path.basename(os.path.abspath(root))), (), ("**/*.go",))


def node(root: str) -> BuildInfo | None:
    text = _read(root, "package.json")
    if text is None:
        return None
    try:
        o = json.loads(text)
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    s = lambda k: "" if o.get(k) is None else o[k] if isinstance(o[k], str) else json.dumps(o[k])
    entry = first_filled(s("module"), s("main"))
    return BuildInfo("node", "", first_filled(s("name"), os.path.basename(os.path.abspath(root))), (entry,) if entry else (), ("src/**/*.ts", "src/**/*.js"))


def detect(root: str) -> BuildInfo:
    """The first of Maven, Gradle, Go and Node whose files are there and can be parsed."""
    return next((x for x in (f(root) for f in (maven, gradle, golang, node)) if x), BuildInfo())


def merged(header: dict, info: BuildInfo, compat: bool = True) -> dict:
    """``header`` with what it lacks. Its module is set from the folder's name beforehand, so a detected one comes in only without ``compat``."""
    out = dict(header)
    for key, value in (("build", info.build), ("jdk", info.jdk), ("entrypoints", list(info.entrypoints)), ("sourceGlobs", list(info.globs)), ("module", info.module)):
        if value and (not out.get(key) or (key == "module" and not compat)):
            out[key] = value
    return out


