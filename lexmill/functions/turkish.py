"""The published Snowball algorithm for Turkish: suffixes are peeled off a cursor from the end of the word."""

from __future__ import annotations

_VOWELS = "aeıioöuü"
_HARMONY = {"a": "aıou", "e": "eiöü", "ı": "aı", "i": "ei", "o": "ou", "ö": "öü", "u": "ou", "ü": "öü"}

#: name -> (endings, whether vowels must agree, optional letter before the ending)
_MARKS = {
    "possessives": ("m n miz niz muz nuz mız nız müz nüz", False, "U"),
    "lArI": ("leri ları", False, ""),
    "sU": ("ı i u ü", True, "s"),
    "yU": ("ı i u ü", True, "y"),
    "nU": ("ni nu nı nü", True, ""),
    "nUn": ("in un ın ün", True, "n"),
    "yA": ("a e", True, "y"),
    "nA": ("na ne", True, ""),
    "DA": ("da ta de te", True, ""),
    "ndA": ("nda nde", True, ""),
    "DAn": ("dan tan den ten", True, ""),
    "ndAn": ("ndan nden", True, ""),
    "ylA": ("la le", True, "y"),
    "ki": ("ki", False, ""),
    "ncA": ("ca ce", True, "n"),
    "yUm": ("im um ım üm", True, "y"),
    "sUn": ("sin sun sın sün", True, ""),
    "yUz": ("iz uz ız üz", True, "y"),
    "sUnUz": ("siniz sunuz sınız sünüz", False, ""),
    "lAr": ("lar ler", True, ""),
    "nUz": ("niz nuz nız nüz", True, ""),
    "DUr": ("dir tir dur tur dır tır dür tür", True, ""),
    "cAsInA": ("casına cesine", False, ""),
    "yDU": (" ".join(f"{c}{v}{e}" for c in "dt" for v in "iuıü" for e in ("", "k", "m", "n")), True, "y"),
    "ysA": ("sa se sak sek sam sem san sen", True, "y"),
    "ymUs": ("miş muş mış müş", True, "y"),
    "yken": ("ken", False, "y"),
}
_ENDINGS = {k: (sorted(v[0].split(), key=len, reverse=True), v[1], v[2]) for k, v in _MARKS.items()}


class _Word:
    """A word with a cursor that moves towards its start, and the end of what would be cut."""

    def __init__(self, word: str):
        self.w, self.at = word, len(word)
        self.end = self.at

    def _agrees(self) -> bool:
        """The last vowel before the cursor is in harmony with one further left."""
        k = self.at - 1
        while k >= 0 and self.w[k] not in _VOWELS:
            k -= 1
        return k >= 0 and any(c in _HARMONY[self.w[k]] for c in self.w[:k])

    def _optional(self, at: int, letter: str) -> int | None:
        """Where the cursor is after a joining letter that may be there, between vowels (or a vowel between consonants); None if it can't."""
        near = self.w[at - 1 : at] if at else ""
        if not near:
            return None
        behind = self.w[at - 2 : at - 1] if at > 1 else ""
        if letter == "U":
            vowel = near in "ıiuü"
            return None if not behind or behind in _VOWELS else at - 1 if vowel else at
        if not behind or behind not in _VOWELS:
            return None
        return at - 1 if near == letter else at

    def mark(self, *names: str) -> bool:
        """Move over the first of the suffixes that stands before the cursor."""
        for name in names:
            endings, harmony, optional = _ENDINGS[name]
            if harmony and not self._agrees():
                continue
            head = self.w[: self.at]
            s = next((s for s in endings if head.endswith(s)), None)
            if s is None:
                continue
            at = self.at - len(s)
            if optional:
                at = self._optional(at, optional)
                if at is None:
                    continue
            self.at = at
            return True
        return False

    def open(self) -> None:
        self.end = self.at

    def cut(self) -> bool:
        self.w = self.w[: self.at] + self.w[self.end :]
        self.end = self.at
        return True

    def attempt(self, step) -> bool:
        """Do a step; the cursor goes back if it fails."""
        at, n = self.at, len(self.w)
        if step():
            return True
        self.at = at if len(self.w) == n else min(at, len(self.w))
        return False

    def plural_chain(self) -> bool:
        def step():
            self.open()
            return self.mark("lAr") and self.cut() and self.before_ki()

        self.attempt(step)
        return True

    def before_ki(self) -> bool:
        self.open()
        if not self.mark("ki"):
            return False
        at = self.at
        if self.mark("DA"):
            self.cut()

            def step():
                self.open()
                if self.mark("lAr"):
                    self.cut()
                    self.attempt(self.before_ki)
                    return True
                return self.mark("possessives") and self.cut() and self.plural_chain()

            self.attempt(step)
            return True
        self.at = at
        if self.mark("nUn"):
            self.cut()

            def step():
                self.open()
                if self.mark("lArI"):
                    return self.cut()
                self.open()
                if self.mark("possessives", "sU"):
                    self.cut()
                    return self.plural_chain()
                return self.before_ki()

            self.attempt(step)
            return True
        self.at = at
        if not self.mark("ndA"):
            return False
        return self._after_case()

    def _after_case(self) -> bool:
        if self.mark("lArI"):
            return self.cut()
        if self.mark("sU"):
            self.cut()
            return self.plural_chain()
        return self.attempt(self.before_ki)

    def verb(self) -> bool:
        """Endings of predicates; false if no noun ending may follow."""
        self.open()
        start, more = self.at, True
        persons = ("sUnUz", "lAr", "yUm", "sUn", "yUz")
        if not self.mark("ymUs", "yDU", "ysA", "yken"):
            if self.mark("cAsInA") and (self.mark(*persons) or True) and self.mark("ymUs"):
                pass
            else:
                self.at = start
                if self.mark("lAr"):
                    self.cut()
                    self.attempt(lambda: self.open() or self.mark("DUr", "yDU", "ysA", "ymUs"))
                    more = False
                elif self.mark("nUz") and self.mark("yDU", "ysA"):
                    pass
                else:
                    self.at = start
                    if self.mark("sUnUz", "yUz", "sUn", "yUm"):
                        self.cut()
                        self.attempt(lambda: self.open() or self.mark("ymUs"))
                    elif self.mark("DUr"):
                        self.cut()
                        self.attempt(lambda: self.open() or ((self.mark(*persons) or True) and self.mark("ymUs")))
                    else:
                        return True
        self.cut()
        return more

    def noun(self) -> None:
        start = self.at
        self.open()
        if self.mark("lAr"):
            self.cut()
            self.attempt(self.before_ki)
            return
        if self.mark("ncA"):
            self.cut()

            def step():
                self.open()
                if self.mark("lArI"):
                    return self.cut()
                if self.mark("possessives", "sU"):
                    self.cut()
                    return self.plural_chain()
                return self.mark("lAr") and self.cut() and self.before_ki()

            self.attempt(step)
            return
        if self.mark("ndA", "nA"):
            if self._after_case():
                return
            self.at = start
            self.open()
        if self.mark("ndAn", "nU"):
            if self.mark("sU"):
                self.cut()
                self.plural_chain()
                return
            if self.mark("lArI"):
                return
            self.at = start
            self.open()
        if self.mark("DAn"):
            self.cut()

            def step():
                self.open()
                if self.mark("possessives"):
                    self.cut()
                    return self.plural_chain()
                if self.mark("lAr"):
                    self.cut()
                    self.attempt(self.before_ki)
                    return True
                return self.before_ki()

            self.attempt(step)
            return
        if self.mark("nUn", "ylA"):
            self.cut()

            def step():
                at = self.at
                self.open()
                if self.mark("lAr"):
                    self.cut()
                    if self.before_ki():
                        return True
                    at = min(at, len(self.w))
                self.at = at
                self.open()
                if self.mark("possessives", "sU"):
                    self.cut()
                    return self.plural_chain()
                return self.before_ki()

            self.attempt(step)
            return
        if self.mark("lArI"):
            self.cut()
            return
        if self.attempt(self.before_ki):
            return
        self.at = min(start, len(self.w))
        self.open()
        if self.mark("DA", "yU", "yA"):
            self.cut()

            def step():
                self.open()
                if self.mark("possessives"):
                    self.cut()
                    self.attempt(lambda: self.open() or self.mark("lAr"))
                elif not self.mark("lAr"):
                    return False
                self.cut()
                self.open()
                return self.before_ki()

            self.attempt(step)
            return
        if self.mark("possessives", "sU"):
            self.cut()
            self.plural_chain()


def turkish(word: str) -> str:
    if sum(c in _VOWELS for c in word) < 2:
        return word
    x = _Word(word)
    if not x.verb():
        return x.w
    x.at = x.end = len(x.w)
    x.noun()
    w = x.w
    if w in ("ad", "soyad"):
        return w
    last = next((c for c in reversed(w) if c in _VOWELS), "")
    if w.endswith(("d", "g")) and last:
        w += {"a": "ı", "ı": "ı", "e": "i", "i": "i", "o": "u", "u": "u", "ö": "ü", "ü": "ü"}[last]
    return w[:-1] + {"b": "p", "c": "ç", "d": "t", "ğ": "k"}.get(w[-1:], w[-1:])
