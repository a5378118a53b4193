"""A lexer for JavaScript and TypeScript: words, strings, templates, numbers and signs with their lines; comments and patterns are passed over."""

from __future__ import annotations

from dataclasses import dataclass

#: Words after which a slash begins a pattern, not a division.
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}
PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    kind: str  # word, text, template, number, sign
    text: str  # of texts and templates what they say, holes as they stand
    line: int


class Lexer:
    def __init__(self, source: str):
        self.source, self.at, self.line, self.tokens = source, 0, 1, []

    def run(self, until: str = "") -> list[Token]:
        """Tokens up to the sign ``until`` that closes what began before, or to the end of the source."""
        depth = 0
        while self.at < len(self.source):
            c = self.source[self.at]
            if c == "\n":
                self.line += 1
                self.at += 1
            elif c.isspace():
                self.at += 1
            elif self.source.startswith("//", self.at):
                self._skip_to("\n", keep=True)
            elif self.source.startswith("/*", self.at):
                self._skip_to("*/")
            elif c in "'\"":
                self._text(c)
            elif c == "`":
                self._template()
            elif c == "/" and self._pattern_may_begin():
                self._pattern()
            elif c.isalpha() or c in "_$":
                self._word()
            elif c.isdigit():
                self._number()
            else:
                if until and c == until and depth == 0:
                    self.at += 1
                    return self.tokens
                depth += (c == "{") - (c == "}")
                size = 2 if self.source.startswith("=>", self.at) else 1
                self._add("sign", self.source[self.at : self.at + size], self.line)
                self.at += size
        return self.tokens

    def _add(self, kind: str, text: str, line: int) -> None:
        self.tokens.append(Token(kind, text, line))

    def _skip_to(self, mark: str, keep: bool = False) -> None:
        end = self.source.find(mark, self.at + (0 if keep else 2))
        end = len(self.source) if end < 0 else end + (0 if keep else len(mark))
        self.line += self.source.count("\n", self.at, end)
        self.at = end

    def _escaped(self) -> str:
        """What an escape stands for; the place is at the backslash."""
        follows = self.source[self.at + 1 : self.at + 2]
        self.line += follows == "\n"
        self.at += 2
        return {"n": "\n", "t": "\t", "r": "\r", "\n": ""}.get(follows, follows)

    def _text(self, quote: str) -> None:
        line, said = self.line, []
        self.at += 1
        while self.at < len(self.source) and self.source[self.at] not in (quote, "\n"):
            if self.source[self.at] == "\\":
                said.append(self._escaped())
            else:
                said.append(self.source[self.at])
                self.at += 1
        self.at += self.source[self.at : self.at + 1] == quote
        self._add("text", "".join(said), line)

    def _template(self) -> None:
        line, said, inner = self.line, [], []
        self.at += 1
        while self.at < len(self.source) and self.source[self.at] != "`":
            if self.source[self.at] == "\\":
                said.append(self._escaped())
            elif self.source.startswith("${", self.at):
                hole = Lexer(self.source)
                hole.at, hole.line = self.at + 2, self.line
                inner += hole.run("}")
                said.append(self.source[self.at : hole.at])
                self.at, self.line = hole.at, hole.line
            else:
                self.line += self.source[self.at] == "\n"
                said.append(self.source[self.at])
                self.at += 1
        self.at += 1
        self._add("template", "".join(said), line)
        self.tokens += inner

    def _pattern_may_begin(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        return last.text in BEFORE_PATTERN if last.kind == "word" else last.kind == "sign" and last.text not in (")", "]", "}")

    def _pattern(self) -> None:
        end, in_class = self.at + 1, False
        while end < len(self.source) and self.source[end] != "\n" and (in_class or self.source[end] != "/"):
            in_class = self.source[end] == "[" or (in_class and self.source[end] != "]")
            end += 2 if self.source[end] == "\\" else 1
        if self.source[end : end + 1] != "/":  # a division after all
            self._add("sign", "/", self.line)
            self.at += 1
            return
        self.at = end + 1
        while self.source[self.at : self.at + 1].isalpha():
            self.at += 1

    def _word(self) -> None:
        start = self.at
        while self.at < len(self.source) and (self.source[self.at].isalnum() or self.source[self.at] in "_$"):
            self.at += 1
        self._add("word", self.source[start : self.at], self.line)

    def _number(self) -> None:
        start = self.at
        while self.at < len(self.source) and (self.source[self.at].isalnum() or self.source[self.at] in "._"):
            self.at += 1
        self._add("number", self.source[start : self.at], self.line)


def tokens(source: str) -> list[Token]:
    return Lexer(source).run()


def closing(found: list[Token], at: int) -> int:
    """Place of the sign that closes the one at ``at``; the end if none does."""
    wanted = []
    for i in range(at, len(found)):
        if found[i].kind != "sign":
            continue
        if found[i].text in PAIRS:
            wanted.append(PAIRS[found[i].text])
        elif wanted and found[i].text == wanted[-1]:
            wanted.pop()
            if not wanted:
                return i
    return len(found)
