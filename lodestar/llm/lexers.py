"""Token streams of the bundled grammars: files as lines of one-character terminals."""

from __future__ import annotations

import re
from collections.abc import Callable

from . import grammars
from .lalr import END, Grammar, Tables, build, parse, with_characters

BAD = "\x01"


class Language:
    """Tables, terminals and the cutting of a text into lines of terminals."""

    def __init__(self, grammar: str, master: str, kinds: Callable[[str], str], fixed: dict[str, str], lines: Callable | None = None, asi: str | None = None, close: str = "") -> None:
        names = sorted(Grammar(grammar).terminals)
        self.char = {}
        for i, n in enumerate(names):
            bare = n[1:-1] if n[0] == "'" else n
            self.char[n] = bare if n[0] == "'" and len(bare) == 1 and not bare.isalnum() else chr(0xE000 + i)
        self.char["$"] = END
        self.tables: Tables = with_characters(build(grammar), self.char, asi)
        self.find = re.compile(master).findall
        words = {n[1:-1]: c for n, c in self.char.items() if n[0] == "'"}
        self.words = words | {t: "".join(self.char[x] for x in k.split()) for t, k in fixed.items()}
        self.kinds, self._lines, self.close = kinds, lines, close
        self.map = _Terminals(self)

    def of(self, *names: str) -> str:
        return "".join(self.char[n] for n in names)

    def terminals(self, text: str) -> str:
        look = self.map.__getitem__
        return "".join(map(look, self.find(text)))

    def first_error(self, text: str) -> int | None:
        """Number of the line that holds the first unrecoverable error, or None."""
        rows = self._lines(self, text) if self._lines else list(enumerate(self.terminals(text).split("\n"), 1))
        found = parse(self.tables, rows, self.close)
        return None if found is None else found[0]


class _Terminals(dict):
    def __init__(self, language: Language) -> None:
        self._l = language

    def __missing__(self, token: str) -> str:
        lang = self._l
        got = lang.words.get(token)
        if got is None:
            k = lang.kinds(token)
            got = "\n" * token.count("\n") if k == "" else k if k and k[0] in "\x01\n" else "".join(lang.char[x] if x in lang.char else lang.words[x] for x in k.split())
            if k != "" and "\n" in token and k[0] not in "\x01\n":
                got += ""
        if len(token) < 40 and len(self) < 500_000:
            self[token] = got
        return got


_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_CCOM = r"//[^\n]*|/\*[\s\S]*?\*/"


def _number(t: str) -> bool:
    return t[0].isdigit() or t[0] == "." and len(t) > 1 and t[1].isdigit()


# --- JSON
_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')


def _json(t: str) -> str:
    if t[0] == '"':
        return "STR" if _JSON_STRING.fullmatch(t) else BAD
    if t in ("true", "false", "null"):
        return "WORD"
    return "NUM" if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", t) else BAD


def json_language() -> Language:
    lang = Language(grammars.JSON, r'"(?:[^"\\\n]|\\.)*"|[-+\w.]+|\n|\S', _json, {})
    lang.words["\n"] = "\n"
    return lang


# --- JavaScript and TypeScript
_TPL = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`)*\})*`"
_REGEX = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_SCRIPT = (
    _CCOM + "|" + _DQ + "|" + _SQ + "|" + _TPL + r"|(?:[=(,:;!&|?{\[+~]|\breturn|\n)[ \t]*" + _REGEX + r"|^#![^\n]*|#[A-Za-z_]\w*|\.\.\.|\?\.(?!\d)|\.\s*#?[A-Za-z_$][\w$]*|\d[\w.]*|\.\d\w*"
    r"|async[ \t](?=[ \t]*[\w$*#\[])|async(?=[ \t]*\([^()\n]*(?:\([^()]*\)[^()\n]*)*\)[^;\n{}]*=>)|type[ \t](?=[ \t]*[A-Za-z_$][\w$]*\s*(?:<|=[^=>]))|(?:interface|enum|namespace|abstract|declare|implements|keyof|is|as|from|of)[ \t](?=[ \t]*[\w$'\"{*\[(])"
    r"|(?:public|private|protected|readonly|override|accessor)[ \t](?=[ \t]*[\w$#\[{*])|[\w$\u0080-￿]+"
    r"|=>|===|!==|==|!=|<=|>=(?!>)|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\*\*=|\*\*|\+\+|--|<<=|>>>=|>>=|[-+*/%&|^]=|<<|\n|\S"
)
_BIN = {o: "BIN" for o in "=== !== == != <= >= && || ?? / % ** ^ << instanceof".split()}
_ASGS = {o: "ASG" for o in "&&= ||= ??= **= <<= >>= >>>= += -= *= /= %= &= |= ^=".split()}


def _script_kinds(types: bool) -> Callable[[str], str]:
    def kinds(t: str) -> str:
        c = t[0]
        if t.startswith(("//", "/*", "#!")):
            return ""
        if c in "\"'":
            return "STR" if len(t) > 1 else BAD
        if c == "`":
            return "TPL" if len(t) > 1 else BAD
        if c == "." and len(t) > 1 and t != "..." and not _number(t):
            return "DOT"
        if len(t) > 1 and t.endswith("/") or len(t) > 2 and "/" in t and (c in "=(,:;!&|?{[+~\n" or t.startswith("return")):
            head = "return" if t.startswith("return") else c
            return ("\n" + "" if c == "\n" else ("'{'" if c == "{" else f"'{head}'") + " STR") if c != "\n" else "STR"
        if _number(t):
            return "NUM"
        return "ID" if c.isalnum() or c in "_$#" or ord(c) > 127 else BAD

    return kinds


def _script_lines(lang: Language, text: str) -> list[tuple[int, str]]:
    if lang.types:
        text = re.sub(r"\)\s*:\s*[^()=;{}\n]+?=>", ") =>", text)
    s = lang.terminals(text)
    s = lang.objects.sub(lang.object, s)
    return list(enumerate(s.split("\n"), 1))


def _script_language(types: bool) -> Language:
    fixed = _BIN | _ASGS | {"++": "INC", "--": "INC", "const": "VAR", "let": "VAR", "var": "VAR", "from ": "FROM", "from": "FROM", "async": "ASYNC", "async ": "ASYNC", "{": "'{'", "of ": "'of'", "as ": "'as'"}
    if types:
        fixed |= {x + " ": "MOD" for x in "public private protected readonly override accessor".split()}
        fixed |= {x + " ": f"'{x}'" for x in "type interface enum namespace declare abstract implements keyof is".split()}
    lang = Language(grammars.TYPESCRIPT if types else grammars.JAVASCRIPT, _SCRIPT, _script_kinds(types), fixed, _script_lines, "';'", "}")
    lang.types = types
    for word in "type interface enum namespace declare abstract implements keyof is of as".split():
        if word in lang.words:
            lang.words[word] = lang.char["ID"] if word != "of" else lang.words["of"]
    lang.words["\n"] = "\n"
    before = "=([,:?&|!~+-*<" + lang.of("ASG", "BIN", "VAR", "'return'", "'throw'", "'in'", "'of'", "'...'", "'typeof'", "'new'", "'yield'", "'await'", "'default'", "'extends'")
    lang.tables.restricted = lang.char["INC"]
    lang.objects = re.compile("([" + re.escape(before) + "]\n*)\\{")
    lang.object = "\\1" + lang.char["OBJ"]
    return lang


# --- Python
_PY = (
    r"#[^\n]*|(?:[rRbBfFuU]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + _DQ + "|" + _SQ + r")"
    r"|\\\r?\n|\.\.\.|\.(?![ \t]*import\b)[ \t]*[^\W\d]\w*|0[xX]\w+|\d[\w.]*[eE][+-]\d\w*|\d[\w.]*|\.\d\w*(?:(?<=[eE])[+-]\d\w*)?|[^\W\d]\w*|:=|->|\*\*=|//=|>>=|<<=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|\n[ \t\f]*|\S"
)
_PYBIN = {o: "BIN" for o in "// % & | ^ << >> == != < > <= >= and or".split()}
_PYAUG = {o: "AUG" for o in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()}


def _python_kinds(t: str) -> str:
    c = t[0]
    if c == "#" or t[0] == "\\" and len(t) > 1:
        return ""
    if c in "\"'" or t[-1] in "\"'" and len(t) > 1:
        return "STR" if len(t) > 1 and t[-1] in "\"'" else BAD
    if c == "." and len(t) > 1 and not _number(t):
        return "DOT"
    if _number(t):
        return "NUM" if _PYNUM.fullmatch(t) else BAD
    return "ID" if c.isalnum() or c == "_" or ord(c) > 127 and t.isidentifier() else BAD


_PYNUM = re.compile(r"(?i)0x[\da-f_]+|0o[0-7_]+|0b[01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:e[+-]?\d[\d_]*)?j?")


_SOFT = re.compile(r"(match|case)\b(?=[ \t]+[^=\s)\].,]|[ \t]*[\[({'\"\-*])(?=.*:\s*(?:#.*)?$|.*:[ \t]+\S)")


def _python_lines(lang: Language, text: str) -> list[tuple[int, str]]:
    """Logical lines; newlines in brackets are none; INDENT and DEDENT as lines of their own."""
    look, nl, indent, dedent = lang.map.__getitem__, lang.char["NL"], lang.char["INDENT"], lang.char["DEDENT"]
    soft = {"match": lang.words["match"], "case": lang.words["case"]}
    out: list[tuple[int, str]] = []
    levels, depth, no, line, width, first = [0], 0, 1, [], 0, True
    tokens = lang.find("\n" + text.replace("\r\n", "\n") + "\n")
    sources = None
    no = 0
    for k, t in enumerate(tokens):
        c = t[0]
        if c == "\n":
            if depth == 0 and line:
                out.append((no, "".join(line) + nl))
                line = []
            no += 1
            if depth == 0 and not line:
                width = len(t[1:].expandtabs(8))
                first = True
            continue
        if c == "#":
            continue
        if c == "\\" and len(t) > 1:
            no += 1
            continue
        if first:
            first = False
            if width > levels[-1]:
                levels.append(width)
                out.append((no, indent))
            else:
                while width < levels[-1]:
                    levels.pop()
                    out.append((no, dedent))
                if width != levels[-1]:
                    out.append((no, BAD))
            if t in soft:
                if sources is None:
                    sources = text.replace("\r\n", "\n").split("\n")
                if _SOFT.match(sources[no - 1].lstrip()):
                    line.append(soft[t])
                    continue
            elif t == "type":
                if sources is None:
                    sources = text.replace("\r\n", "\n").split("\n")
                if re.match(r"type[ \t]+\w+[ \t]*[=\[]", sources[no - 1].lstrip()):
                    continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        no += t.count("\n")
        line.append(look(t) if t not in soft else lang.char["ID"])
    if line:
        out.append((no, "".join(line) + ("" if depth else nl)))
    return [*out, *((no, dedent) for _ in levels[1:])]


def python_language() -> Language:
    lang = Language(grammars.PYTHON, _PY, _python_kinds, _PYBIN | _PYAUG | {"print": "ID"}, _python_lines)
    return lang


# --- Go
_GO = (
    _CCOM + "|" + _DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|\.\.\.|\.[A-Za-z_]\w*|\d[\w.]*(?:[eEpP][+-]\d+)?|\.\d\w*|[^\W\d]\w*|(?<=[\w\]})])\{|:=|<-|\+\+|--|<<=|>>=|&\^=|[-+*/%&|^]="
    r"|&&|\|\||==|!=|<=|>=|<<|>>|&\^|\n|\S"
)
_GOBIN = {o: "BIN" for o in "/ % && || == != < > <= >= << >> &^".split()}


def _go_kinds(t: str) -> str:
    c = t[0]
    if t.startswith(("//", "/*")):
        return ""
    if c in "\"'`":
        return "STR" if len(t) > 1 else BAD
    if c == "." and len(t) > 1 and t != "..." and not _number(t):
        return "DOT"
    if _number(t):
        return "NUM"
    return "ID" if c.isalnum() or c == "_" else BAD


def _go_lines(lang: Language, text: str) -> list[tuple[int, str]]:
    s = lang.terminals(re.sub(r"(?<=[\w\]})])\{", "\x03", re.sub(r"\b(struct|interface)\{", r"\1 {", text)) if "\x03" not in text else text)
    s = lang.inner.sub(lang.char["LIT"], s)
    out = []
    for no, line in enumerate(s.split("\n"), 1):
        if line and line[-1] in lang.enders:
            line += ";"
        out.append((no, line))
    if out and s and s[-1] not in "\n;":
        pass
    return out


def go_language() -> Language:
    fixed = _GOBIN | {o: "ASG" for o in "+= -= *= /= %= &= |= ^= <<= >>= &^=".split()} | {"++": "INC", "--": "INC", "<-": "ARROW", "\x03": "LIT"}
    lang = Language(grammars.GO, _GO.replace(r"(?<=[\w\]})])\{", "\x03"), _go_kinds, fixed, _go_lines)
    lang.words["\n"] = "\n"
    lang.enders = set(lang.of("ID", "NUM", "STR", "DOT", "INC", "'return'", "'break'", "'continue'", "'fallthrough'")) | set(")]}")
    lang.inner = re.compile("(?!)")
    return lang


# --- Rust
_RS = (
    r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/|b?r(#*)\"[\s\S]*?\"\1|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'|'[A-Za-z_]\w*"
    r"|\d(?:[\w]|\.(?=\d)|\.(?![.\w]))*(?:(?<=[eE])[+-]\d+)?|(?<!\.)\.(?:[A-Za-z_]\w*|\d+)|r#[A-Za-z_]\w*|[^\W\d]\w*|::|->|=>|\.\.=|\.\.\.|\.\.|<<=|>>=|&&|\|\||==|!=|<=|>=|<<|[-+*/%^&|]=|\n|\S"
)


def _rust_kinds(t: str) -> str:
    c = t[0]
    if t.startswith(("//", "/*")):
        return ""
    if c == '"' or t[-1] == '"' and len(t) > 1 or t[-1] == "#" and '"' in t:
        return "STR" if len(t) > 1 else BAD
    if c == "'" or t.startswith("b'"):
        return ("STR" if t[-1] == "'" else "LIFE") if len(t) > 1 else BAD
    if c == "." and len(t) > 1 and t[1] != ".":
        return "DOT"
    if c.isdigit():
        return "NUM"
    return "ID" if c.isalnum() or c == "_" else BAD


def _rust_lines(lang: Language, text: str) -> list[tuple[int, str]]:
    s = "".join(map(lang.map.__getitem__, (m.group() for m in lang.iter(text))))
    prev = None
    while prev != s:
        prev, s = s, lang.literal.sub(lang.to, s)
    return list(enumerate(s.split("\n"), 1))


def rust_language() -> Language:
    fixed = {o: "BIN" for o in "/ % ^ == != <= >= <<".split()} | {o: "ASG" for o in "+= -= *= /= %= ^= &= |= <<= >>=".split()} | {"||": "OROR", "..=": "'..'", "...": "'..'"}
    fixed |= {x: "KW" for x in ("yield", "become", "box", "priv")}
    lang = Language(grammars.RUST, _RS, _rust_kinds, fixed, _rust_lines)
    lang.words["\n"] = "\n"
    lang.words["_"] = lang.char["'_'"]
    lang.iter = re.compile(_RS).finditer
    heads = lang.of("'if'", "'while'", "'match'", "'for'", "'loop'", "'unsafe'", "'impl'", "'fn'", "'struct'", "'enum'", "'trait'", "'mod'", "'extern'", "'else'", "'where'", "'async'", "'->'", "'in'")
    lang.literal = re.compile("((?:^|[;{}\n" + lang.char["LIT"] + "])[^;{}\n" + heads + "]*[" + lang.of("ID", "'self'") + ">])\\{")
    lang.to = "\\1" + lang.char["LIT"]
    return lang


# --- Bash
_SUB = r"\$\((?:[^()\"'\\]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\((?:[^()\"']|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\([^()]*\))*\))*\)"
_BDQ = r"\"(?:[^\"\\$`]|\\[\s\S]|" + _SUB + r"|\$\{(?:[^{}]|\{[^{}]*\}|\$\{[^{}]*\})*\}|\$(?![({])|`[^`]*`)*\""
_ATOM = r"(?:[^\s\"'`$\;&|<>()#]|\\[\s\S]|'[^']*'|" + _BDQ + "|" + _SUB + r"|\$\{(?:[^{}]|\{[^{}]*\}|\$\{[^{}]*\})*\}|\$'(?:[^'\\]|\\.)*'|\$[\w@*#?$!-]|`[^`]*`|\$(?=[\s\"/.,:;|)]))"
_SH = (
    r"(?:(?<=[\s;&|()])|^)#[^\n]*|\\\r?\n|\[\[\s(?:[^\]\"'\n]|\"(?:[^\"\\]|\\.)*\"|'[^']*'|\](?!\])|\[:\w+:\]|\\\n|\n)*\]\]|\(\((?:[^()\n]|\([^()]*\))*\)\)|[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=\("
    r"|<\(|>\(|\d*(?:>>|<<-?|<>|>&|<&|&>>|&>|>\||<<<|>|<)(?:\d+|-)?|;;&|;;|;&|&&|\|\||\|&|" + _ATOM + r"(?:" + _ATOM + r"|#)*|\n|[^\s]"
)
_HEREDOC = re.compile(r"(<<-?[ \t]*(?:\"(\w+)\"|'(\w+)'|\\?(\w+))[^\n]*\n)(?:.*\n)*?[ \t]*(?:\2|\3|\4)[ \t]*(?=\n|$)")


def _bash_kinds(t: str) -> str:
    c = t[0]
    if c == "#" or t.startswith("\\\n") or t.startswith("\\\r"):
        return ""
    if t.startswith("[["):
        return "COND" if len(t) > 3 and t.endswith("]]") else "WORD" if t == "[[" and False else BAD
    if t.startswith("((") and t.endswith("))"):
        return "ARITH"
    if t.endswith("=(") and len(t) > 2:
        return "ARR"
    if t in (";;", ";&", ";;&"):
        return "DSEMI"
    if t == "|&":
        return "'|'"
    if re.fullmatch(r"\d*(?:>>|<<-?|<>|>&|<&|&>>|&>|>\||<<<|>|<)(?:\d+|-)?", t):
        return "" if re.search(r"[<>]&(?:\d+|-)$", t) else "REDIR"
    if c in "\"'`" and (len(t) == 1):
        return BAD
    return "WORD" if t not in ("(", ")", "&", "|", ";") else f"'{t}'"


def _bash_lines(lang: Language, text: str) -> list[tuple[int, str]]:
    text = text.replace("\r\n", "\n")
    if "<<" in text:
        text = _HEREDOC.sub(lambda m: m.group(1)[:-1] + "\n" * m.group(0).count("\n") if m.group(0) else "", text)
    nl = lang.char["NL"]
    s = lang.terminals(text)
    return [(no, line + nl) for no, line in enumerate(s.split("\n"), 1) if line]


def bash_language() -> Language:
    lang = Language(grammars.BASH, _SH, _bash_kinds, {"&&": "AND", "||": "AND", "<(": "'('", ">(": "'('"}, _bash_lines)
    lang.words["\n"] = "\n"
    return lang


# --- TOML
_TOML = r"#[^\n]*|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|\[\[(?=[^\[\]\n]*\]\][ \t]*(?:#[^\n]*)?(?:\n|\r|$))|[+-]?\d[\w:+.-]*(?:[ ]\d\d:[\d:.]+\S*)?|[\w-]+|[+-](?:inf|nan)|\n|\S"


def _toml_kinds(t: str) -> str:
    c = t[0]
    if c == "#":
        return ""
    if c in "\"'":
        return "STR" if len(t) > 1 else BAD
    if t == "[[":
        return "TABLES"
    if c.isdigit() or c in "+-" and len(t) > 1 and (t[1].isdigit() or t[1:] in ("inf", "nan")):
        return "NUM"
    return "BARE" if re.fullmatch(r"[\w-]+", t) and t.isascii() else BAD


_TOMLKEY = re.compile(r"(?m)^([ \t]*)((?:[\w-]+|\"[^\"\n]*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w-]+|\"[^\"\n]*\"|'[^'\n]*'))*)([ \t]*=)")
_TOMLHEAD = re.compile(r"(?m)^([ \t]*\[\[?)([^\[\]\n=,]+)(\]\]?[ \t]*(?:#.*)?)$")
_TOMLBARE = re.compile(r"^(?:true|false|inf|nan)$")


def _toml_lines(lang: Language, text: str) -> list[tuple[int, str]]:
    nl, bare = lang.char["NL"], lang.char["BARE"]
    text = text.replace("\r\n", "\n")
    plain = lambda m: m.group(1) + re.sub(r"[\w-]+(?=(?:[^\"']*[\"'][^\"']*[\"'])*[^\"']*$)", "k", m.group(2)) + m.group(3)
    text = _TOMLHEAD.sub(plain, _TOMLKEY.sub(plain, text))
    out, no = [], 1
    line: list[str] = []
    after = False
    tokens = lang.find(text)
    for i, t in enumerate(tokens):
        if t == "\n":
            out.append((no, "".join(line) + nl))
            line, after = [], False
            no += 1
            continue
        if t == "=":
            after = True
        c = lang.map[t]
        is_key = i + 1 < len(tokens) and tokens[i + 1] in "=." or i and tokens[i - 1] == "."
        if c == bare and after and t != "k" and not is_key and not _TOMLBARE.match(t):
            c = BAD
        elif c == bare and after and t == "k":
            c = BAD if len(line) and line[-1] == "=" else c
        line.append(c)
        no += t.count("\n")
    out.append((no, "".join(line) + nl))
    return out


def toml_language() -> Language:
    return Language(grammars.TOML, _TOML, _toml_kinds, {}, _toml_lines)


# --- YAML
_YKEY = re.compile(r"((?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|\?|(?![-?:](?:\s|$))[^\s#\[\]{},\"'&*!|>%@`](?:[^#:]|:(?=\S)|(?<=\S)#)*?|<<))[ \t]*:(?=[ \t\r]|$)")
_YFLOW = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'|#[^\n]*|[\[\]{},]|:(?=[\s,\[\]{}]|$)|[&*!][^\s,\[\]{}]*|[^\s\[\]{},:#\"'](?:[^\[\]{},:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)*|\n|\S")
_YPROP = re.compile(r"[&!][^\s,\[\]{}]*")


def _yaml_lines(lang: Language, text: str) -> list[tuple[int, str]]:
    ch = lang.char
    open_, close, dash, key, value, prop, block, sep, fscalar = (ch[x] for x in ("OPEN", "CLOSE", "DASH", "KEY", "VALUE", "PROP", "BLOCKTEXT", "SEP", "FSCALAR"))
    rows = text.replace("\r\n", "\n").split("\n")
    out: list[tuple[int, str]] = []
    levels: list[tuple[int, str]] = []
    i, n = 0, len(rows)

    def level(col: int, kind: str, acc: list[str]) -> None:
        while levels and col < levels[-1][0]:
            levels.pop()
            acc.append(close)
        if levels and col == levels[-1][0]:
            if kind == dash and levels[-1][1] == key:
                return
            while len(levels) > 1 and levels[-1][0] == col and levels[-1][1] != kind and levels[-2][0] == col:
                levels.pop()
                acc.append(close)
            return
        levels.append((col, kind))
        acc.append(open_)

    while i < n:
        raw = rows[i]
        body = raw.lstrip(" ")
        if not body.strip() or body.startswith("#"):
            i += 1
            continue
        no = i + 1
        acc: list[str] = []
        if raw.startswith(("---", "...")) and (len(raw) == 3 or raw[3] in " \t\r"):
            acc += [close] * len(levels)
            levels.clear()
            out.append((no, "".join(acc) + sep))
            rows[i] = "   " + raw[3:]
            if not rows[i].strip():
                i += 1
            continue
        if raw.startswith("%"):
            i += 1
            continue
        if body[0] == "\t":
            out.append((no, BAD))
            return out
        col = len(raw) - len(body)
        rest = body
        structural = False
        while re.match(r"-(?:\s|$)", rest):
            structural = True
            level(col, dash, acc)
            acc.append(dash)
            m = re.match(r"-[ \t]*", rest)
            col += m.end()
            rest = rest[m.end() :]
        m = _YKEY.match(rest)
        if m:
            structural = True
            level(col, key, acc)
            acc.append(key)
            rest = rest[m.end() :].strip()
            if re.match(r"-\s", rest):
                acc.append(BAD)
        rest = rest.strip()
        base = levels[-1][0] if levels else -1
        if rest and not rest.startswith("#"):
            while p := _YPROP.match(rest):
                acc.append(prop)
                rest = rest[p.end() :].strip()
            inner = ch["OPEN"] if not structural and not levels else ""
            if inner:
                levels.append((col, value))
                acc.append(open_)
            elif not structural and col <= base:
                acc.append(BAD)
            if not rest or rest.startswith("#"):
                pass
            elif re.match(r"[|>][-+0-9]*\s*(?:#.*)?$", rest):
                at = base if structural else -1
                if not structural:
                    acc.append(BAD)
                j = i + 1
                while j < n and (not rows[j].strip() or len(rows[j]) - len(rows[j].lstrip(" ")) > at):
                    j += 1
                i = j - 1
                acc.append(block)
            elif rest[0] in "|>%@`":
                acc.append(BAD)
            elif rest[0] in "[{":
                depth, buf = 0, []
                j, part = i, rest
                while True:
                    for t in _YFLOW.findall(part):
                        if t[0] == "#" or t == "\n":
                            continue
                        if t in "[{":
                            depth += 1
                        elif t in "]}":
                            depth -= 1
                        buf.append(t if t in "[]{},:" else prop if t[0] in "&!" else BAD if t in "\"'" else fscalar)
                    if depth <= 0 or j + 1 >= n:
                        break
                    j += 1
                    part = rows[j]
                i = j
                acc.append("".join(buf))
            elif rest[0] in "\"'":
                q = rest[0]
                end = re.compile(r'"(?:[^"\\]|\\[\s\S])*"' if q == '"' else r"'(?:[^']|'')*'")
                whole, j = rest, i
                while not (e := end.match(whole)) and j + 1 < n and j - i < 200:
                    nxt = rows[j + 1]
                    if nxt.strip() and len(nxt) - len(nxt.lstrip(" ")) <= base and base >= 0 and nxt[:1] != " ":
                        break
                    j += 1
                    whole += "\n" + rows[j]
                if not e or whole[e.end() :].strip() and not re.match(r"\s+#", whole[e.end() :]):
                    acc.append(BAD)
                else:
                    i = j
                    acc.append(value)
            else:
                plain = re.split(r"\s#", rest)[0]
                acc.append(BAD if re.search(r":(?:\s|$)", plain) else value)
        out.append((no, "".join(acc)))
        i += 1
    out.append((n, close * len(levels)))
    return out


def yaml_language() -> Language:
    return Language(grammars.YAML, r"\S", lambda t: BAD, {}, _yaml_lines)


MAKERS = {
    ".py": python_language,
    ".js": lambda: _script_language(False),
    ".ts": lambda: _script_language(True),
    ".go": go_language,
    ".rs": rust_language,
    ".sh": bash_language,
    ".json": json_language,
    ".yaml": yaml_language,
    ".toml": toml_language,
}
_MADE: dict[str, Language] = {}


def language(ext: str) -> Language:
    """The language of an extension; its tables are built once per process."""
    if ext not in _MADE:
        _MADE[ext] = MAKERS[ext]()
    return _MADE[ext]
