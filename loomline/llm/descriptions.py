"""Whether a documentation comment tells more than the name and signature it stands at."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Fixed words: fillers of sentences that only restate a signature.
FILLERS = frozenset(
    "a an the this that these of for to from in on with by and or as is are be it its does do did will shall "
    "function functions method methods procedure routine class struct object interface constructor getter setter "
    "description describes documentation doc docs document documented summary comment "
    "returns return returned result results value values given argument arguments arg args param params parameter parameters "
    "input output name names self cls none null void "
    "der die das ein eine methode funktion la le les un une fonction méthode el los las función método".split()
)
#: Fixed phrases: what stands where documentation is still missing. Matched against a whole cleaned sentence.
PLACEHOLDERS = re.compile(
    r"""^(?:
      (?:to\s?do|fix\s?me|xxx|hack|tbd|tba|tbc|wip|n/?a|none|null|nil|nothing|undefined|placeholder|stub|empty|unknown|test|foo|bar|lorem\ ipsum.*)
    | (?:to\ be|will\ be|not|un|needs\ to\ be|should\ be|must\ be|is\ not)[\s-]*(?:yet\ )?(?:documented|described|done|written|added|completed|filled(?:\ in)?|defined|determined|implemented)(?:\ yet|\ later|\ here|\ soon)?
    | (?:please\ )?(?:add|insert|write|enter|put|provide|fill\ in|type)\ (?:a\ |an\ |the\ |your\ |some\ |proper\ |missing\ )*(?:description|documentation|docs?|docstring|comment|summary|text|javadoc|jsdoc)s?(?:\ here|\ later|\ for.*)?
    | (?:document|describe)\ (?:me|this|it)?.*
    | (?:missing|no|without)\ (?:description|documentation|docs?|docstring|comment|summary)(?:\ yet|\ available|\ provided|\ given|\ so\ far)?
    | (?:description|documentation|docstring|comment|summary)(?:\ goes|\ comes)?\ (?:here|missing|pending|to\ follow|follows)
    | (?:this|the)\ (?:function|method|class|code)\ does\ (?:what|exactly\ what|just\ what)\ (?:its|the)\ (?:name|signature)\ (?:says|suggests|implies|states|indicates).*
    | (?:self[\s-]?explanatory|obvious|trivial|see\ (?:above|below|name|code|source|implementation|title|the\ (?:name|code|source|implementation))|as\ (?:above|below|the\ name\ (?:says|suggests)))
    | (?:same|ditto|idem)(?:\ as\ (?:above|below))?
    | auto[\s-]?generated(?:\ \w+)*(?:\ stub|\ code|\ comment|\ javadoc|\ documentation|\ method|\ function|\ block)(?:,.*)?
    | (?:generated|automatically\ generated|auto[\s-]?generated)(?:\ (?:by|from).*)?
    | (?:replace|change|remove|delete|edit|update)\ (?:this|me|the)\b.*\b(?:comment|stub|text|placeholder|body|description)\b.*
    | (?:noch\ )?(?:nicht|zu)\ (?:dokumentiert|beschrieben|dokumentieren|ergänzen|beschreiben)
    | noch\ nicht\ (?:dokumentiert|beschrieben|fertig|implementiert)
    | (?:beschreibung|dokumentation|kommentar)\ (?:fehlt|folgt|ergänzen|einfügen)
    | (?:à|a)\ (?:compléter|documenter|décrire|faire|rédiger|remplir)
    | (?:non|pas\ encore|pas)\ (?:documenté|décrit|renseigné)e?s?
    | (?:por|pendiente\ de|sin)\ (?:documentar|completar|describir|hacer|documentación|descripción)
    | (?:pendiente|falta\ (?:la\ )?(?:documentación|descripción))
    | (?:待|需要?|请|尚未|暂未|还没)(?:补充|完善|添加|填写|编写|写|实现|文档化|记录|完成)(?:说明|注释|文档|描述|内容)?
    | (?:暂无|没有|无|缺少)(?:说明|注释|文档|描述|内容)?
    | (?:ここに)?(?:説明|コメント)(?:を)?(?:追加|記入|未記入).*|未記入|未実装
    )$""",
    re.IGNORECASE | re.VERBOSE,
)
DIRECTIVE = re.compile(
    r"""^\s*(?:
      noqa\b.*|noinspection\b.*|nolint\b.*|nosec\b.*|nopmd\b.*|nocheck\b.*|skipcq\b.*|no\s?cover\b.*
    | (?:es|js|ts|std)lint[\w-]*\b.*|eslint-.*|tslint:.*|jshint\b.*|pylint\s*:.*|flake8\b.*|mypy\s*:.*|pyright\s*:.*|ruff\s*:.*|fmt\s*:.*|yapf\s*:.*|isort\s*:.*|black\s*:.*
    | type\s*:\s*ignore.*|pragma\b.*|go:\w+.*|\+build.*|istanbul\b.*|c8\ .*|v8\ .*|webpack\w*\s*:.*|prettier-.*|biome-.*|sonar.*|checkstyle\b.*|spotless\b.*|formatter\s*:.*
    | @?suppress(?:warnings|lint)?\b.*|region\b.*|endregion\b.*|\#?(?:end)?region.*|<editor-fold.*|</editor-fold.*|-\*-.*-\*-|vim?\s*:.*|@ts-\w+.*|@formatter:\w+|@fmt.*|<[/]?auto-?generated.*
    )\s*$""",
    re.IGNORECASE | re.VERBOSE,
)
LICENCE = re.compile(
    r"copyright\b|©|\(c\)\s*\d{4}|spdx-|licen[cs]ed?\b|all rights reserved|internal use only|proprietary|redistribut|warrant(?:y|ies)\b|urheberrecht|alle rechte vorbehalten|tous droits réservés",
    re.IGNORECASE,
)
TAG = re.compile(
    r"^\s*(?:[@\\](?P<at>[a-zA-Z][\w-]*)|:(?P<field>[a-zA-Z]+)(?:\s+[^:]*)?:)(?P<rest>.*)$"
)
INLINE_TAG = re.compile(r"\{@\w+[^}]*\}")
SECTION = re.compile(
    r"^\s*(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|attributes?|keyword args|examples?|notes?|see also|references|todo)\s*:?\s*$", re.IGNORECASE
)
TODO = re.compile(r"^\s*(?:to\s?do|fix\s?me|xxx|hack|tbd)\b\s*(?:\([^)]*\))?\s*[:,-]?\s*", re.IGNORECASE)
CODE_LINE = re.compile(
    r"""^\s*(?:
      .*[;{}]\s*$
    | (?:return|yield|await|throw|raise|del|assert|import|from|package|goto|break|continue|pass)\b(?:\s+[\w.$\[\]()'"!,=+*/<>-]+){0,3}\s*;?
    | (?:const|let|var|val|final|int|long|string|float|double|bool|boolean|auto)\s+\w+\s*[:=].*
    | [\w.$\[\]'"]+\s*(?::=|[-+*/|&]?=)\s*\S.*
    | (?:for|if|while|switch|elif|with|else\ if|catch|try|func|def|function|class)\b.*[({:].*[)}:]\s*
    | [\w$]+(?:\.[\w$]+)*\([^)]*\)(?:\.[\w$]+\([^)]*\))*\s*;?
    )\s*$""",
    re.IGNORECASE | re.VERBOSE,
)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[^\W\d_A-Za-z]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n\s*\n")


def clean_comment(raw: str | None) -> list[str]:
    """The lines of a comment or docstring without its markers."""
    if not raw:
        return []
    text = raw.replace("\r\n", "\n").replace("\r", "\n").strip()
    text = re.sub(r'^(?:[rRuUbBfF]{0,2})("""|\'\'\'|"|\')(.*)\1$', r"\2", text, flags=re.DOTALL)
    out = []
    for line in text.split("\n"):
        x = line.strip()
        x = re.sub(r"^(?:/\*+!?|\*+/|//+[/!]?|#+!?|--+|;+|%+|\"\"\"|'''|<!--)\s?", "", x)
        x = re.sub(r"^\*+(?!\*)(?:\s|$|/$)", "", x) if x.startswith("*") else x
        x = re.sub(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$", "", x)
        out.append(x.rstrip())
    return out


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "ies", "ied", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def _parts(identifiers: Iterable[str | None]) -> set[str]:
    out: set[str] = set()
    for x in identifiers:
        if x:
            for w in re.split(r"[^\w]+|_", x):
                out.add(w.lower())
                out.update(p.lower() for p in CAMEL.findall(w))
    return out


def description(raw: str | None, name: str | None = None, known: Iterable[str | None] = ()) -> str:
    """What a comment says beyond the name and signature; the empty string where it says nothing.

    Left out are markers, bare tags, directives, licence lines, placeholders, commented-out code and sentences
    that only restate the name, the parameters (`known`) and fillers. A sentence that opens with a to-do mark
    is left out, those that follow it count.
    """
    kept: list[str] = []
    in_section = False
    for line in clean_comment(raw):
        x = INLINE_TAG.sub(" ", line)
        if not x.strip():
            in_section = in_section and bool(kept and False)
            kept.append("")
            continue
        if SECTION.match(x):
            in_section = True
            continue
        if DIRECTIVE.match(x) or LICENCE.search(x) or CODE_LINE.match(x):
            continue
        tag = TAG.match(x)
        if tag:
            kind = (tag["at"] or tag["field"] or "").lower()
            if kind in ("see", "since", "author", "version", "override", "deprecated", "todo", "type", "rtype", "link", "ignore", "internal", "inheritdoc"):
                continue
            x = re.sub(r"^\s*\{[^}]*\}", "", tag["rest"])
            in_section = False
        elif in_section:
            x = re.sub(r"^\s*\*{0,2}\w+\*{0,2}\s*(?:\([^)]*\))?\s*(?::|--?)\s*", "", x)
        if not re.search(r"[^\W_]", x):
            continue
        kept.append(x.strip())
    own = {_stem(w) for w in _parts([name, *known])}
    said: list[str] = []
    for sentence in SENTENCE.split("\n".join(kept)):
        s = " ".join(sentence.split())
        if not s:
            continue
        flat = s.strip(" .!?。！？…:-*_=~#'\"`()[]<>").strip()
        if not flat or TODO.match(s) or PLACEHOLDERS.match(flat) or CODE_LINE.match(s):
            continue
        fresh: set[str] = set()
        wide = 0
        for w in WORD.findall(s):
            if WIDE.search(w):
                wide += len(WIDE.findall(w))
                continue
            pieces = {w.lower(), *(p.lower() for p in CAMEL.findall(w))} if not w.islower() else {w}
            if w.isdigit() or w.lower() in FILLERS:
                continue
            stems = {_stem(p) for p in pieces if p not in FILLERS}
            if _stem(w) in own or (len(pieces) > 1 and all(_stem(p) in own or p == w.lower() for p in pieces)):
                continue
            fresh |= {_stem(w)} if len(pieces) == 1 else stems - own
        if len(fresh) >= 2 or wide >= 4:
            said.append(s)
    return " ".join(said)
