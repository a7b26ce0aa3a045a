"""Suffix stripping for European languages, Turkish and Arabic by the published Snowball algorithms.

Each algorithm is a function from a lower-case word to its stem. A rule table maps suffixes to
what replaces them (or to a function that decides); ``_last`` finds the longest suffix of a table,
within a region if one is given, and the region of a rule is tested after that, as published.
"""

from __future__ import annotations

import re

from .arabic import arabic
from .turkish import turkish


def _after(w: str, vowels: str, at: int = 0) -> int:
    """End of the first non-vowel that follows a vowel; the word's end if there is none."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(w, at)
    return m.end() if m else len(w)


def _regions(w: str, vowels: str, least: int = 0) -> tuple[int, int]:
    """R1 (with at least ``least`` letters before it) and R2."""
    r1 = _after(w, vowels)
    r2 = _after(w, vowels, r1)
    return max(r1, least), r2


def _verb_region(w: str, vowels: str) -> int:
    """RV of the Romance languages."""
    v = lambda c: c in vowels
    if len(w) < 2:
        return len(w)
    if not v(w[1]):
        m = re.compile(f"[{vowels}]").search(w, 2)
        return m.end() if m else len(w)
    if v(w[0]):
        m = re.compile(f"[^{vowels}]").search(w, 2)
        return m.end() if m else len(w)
    return 3 if len(w) >= 3 else len(w)


def _last(w: str, suffixes, limit: int = 0) -> str | None:
    """The longest of the suffixes at the end of the word that begins at ``limit`` or later."""
    for n in range(min(len(w) - limit, max(map(len, suffixes))), 0, -1):
        if w[len(w) - n :] in suffixes:
            return w[len(w) - n :]
    return None


def _table(*groups: tuple[str, str]) -> dict[str, str]:
    """Suffix -> group name from (name, suffixes)."""
    return {s: kind for kind, words in groups for s in words.split()}


def _cut(w: str, suffix: str, to: str = "") -> str:
    return w[: len(w) - len(suffix)] + to


def _drop(w: str, suffix: str, at: int) -> str:
    """The word without the suffix if it has it in the region from ``at``."""
    return _cut(w, suffix) if w.endswith(suffix) and len(w) - len(suffix) >= at else w


# ---------------------------------------------------------------- Germanic


def _nordic_r1(w: str, vowels: str) -> int:
    return max(_after(w, vowels), 3) if len(w) >= 3 else len(w)


_DA = frozenset("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s".split())


def danish(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = _nordic_r1(w, vowels)
    s = _last(w, _DA, r1)
    if s and (s != "s" or w[-2:-1] and w[-2] in "abcdfghjklmnoprtvyzå"):
        w = _cut(w, s)

    def pair(w: str) -> str:
        return w[:-1] if _last(w, ("gd", "dt", "gt", "kt"), r1) else w

    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    s = _last(w, ("ig", "lig", "elig", "els", "løst"), r1)
    if s:
        w = w[:-1] if s == "løst" else pair(_cut(w, s))
    if len(w) > max(r1, 1) and w[-1] not in vowels and w[-2] == w[-1]:
        w = w[:-1]
    return w


_SV = frozenset("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s".split())


def swedish(w: str) -> str:
    r1 = _nordic_r1(w, "aeiouyäåö")
    s = _last(w, _SV, r1)
    if s and (s != "s" or w[-2:-1] and w[-2] in "bcdfghjklmnoprtvy"):
        w = _cut(w, s)
    if _last(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    s = _last(w, ("lig", "ig", "els", "löst", "fullt"), r1)
    if s:
        w = w[:-1] if s in ("löst", "fullt") else _cut(w, s)
    return w


_NO = frozenset("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert".split())


def norwegian(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = _nordic_r1(w, vowels)
    s = _last(w, _NO, r1)
    if s in ("erte", "ert"):
        w = _cut(w, s, "er")
    elif s == "s":
        if w[-2:-1] and (w[-2] in "bcdfghjlmnoprtvyz" or w[-2] == "k" and len(w) > 2 and w[-3] not in vowels):
            w = w[:-1]
    elif s:
        w = _cut(w, s)
    if _last(w, ("dt", "vt"), r1):
        w = w[:-1]
    s = _last(w, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1)
    return _cut(w, s) if s else w


def german(w: str) -> str:
    vowels = "aeiouyäöü"
    w = w.replace("ß", "ss")
    w = re.sub(f"([{vowels}])([uy])(?=[{vowels}])", lambda m: m[1] + m[2].upper(), w)
    r1, r2 = _regions(w, vowels, 3) if len(w) >= 3 else (len(w), len(w))
    s = _last(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1:
        if s in ("em", "ern", "er"):
            w = _cut(w, s)
        elif s != "s":
            w = _cut(w, s)
            if w.endswith("niss"):
                w = w[:-1]
        elif w[-2] in "bdfghklmnrt":
            w = w[:-1]
    s = _last(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1:
        if s != "st":
            w = _cut(w, s)
        elif len(w) >= 6 and w[-3] in "bdfghklmnt":
            w = w[:-2]
    s = _last(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        if s in ("end", "ung"):
            w = _cut(w, s)
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            if not _cut(w, s).endswith("e"):
                w = _cut(w, s)
        elif s in ("lich", "heit"):
            w = _cut(w, s)
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = _cut(w, s)
            s = _last(w, ("lich", "ig"))
            if s and len(w) - len(s) >= r2:
                w = _cut(w, s)
    return w.translate(str.maketrans("äöüUY", "aouuy"))


def dutch(w: str) -> str:
    vowels = "aeiouyè"
    w = w.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(f"^y|(?<=[{vowels}])y", "Y", w)
    w = re.sub(f"([{vowels}])i(?=[{vowels}])", r"\1I", w)
    r1, r2 = _regions(w, vowels, 3) if len(w) >= 3 else (len(w), len(w))
    undouble = lambda w: w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    def en_ending(w: str, s: str) -> str:
        rest = _cut(w, s)
        return undouble(rest) if len(rest) >= r1 and rest and rest[-1] not in vowels and not rest.endswith("gem") else w

    def e_ending(w: str) -> tuple[str, bool]:
        if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in vowels:
            return undouble(w[:-1]), True
        return w, False

    s = _last(w, ("heden", "ene", "en", "se", "s"))
    if s == "heden":
        w = _cut(w, s, "heid") if len(w) - 5 >= r1 else w
    elif s in ("ene", "en"):
        w = en_ending(w, s)
    elif s and len(w) - len(s) >= r1 and len(w) > len(s) and _cut(w, s)[-1] not in vowels + "j":
        w = _cut(w, s)
    w, e_found = e_ending(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = en_ending(w, "en")
    s = _last(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if s and len(w) - len(s) >= r2:
        rest = _cut(w, s)
        if s in ("end", "ing"):
            w = rest
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
            else:
                w = undouble(w)
        elif s == "ig":
            w = w if rest.endswith("e") else rest
        elif s == "lijk":
            w = e_ending(rest)[0]
        elif s == "baar" or e_found:
            w = rest
    if re.search(f"[^{vowels}](?:aa|ee|oo|uu)[^{vowels}I]$", w):
        w = w[:-2] + w[-1]
    return w.replace("Y", "y").replace("I", "i")


# ---------------------------------------------------------------- Romance

_FR_STANDARD = _table(
    ("delete", "ance iqUe isme able iste eux ances iqUes ismes ables istes"), ("ation", "atrice ateur ation atrices ateurs ations"), ("log", "logie logies"), ("u", "usion ution usions utions"), ("ent", "ence ences"), ("ement", "ement ements"),
    ("ité", "ité ités"), ("ive", "if ive ifs ives"), ("eaux", "eaux"), ("aux", "aux"), ("euse", "euse euses"), ("issement", "issement issements"), ("amment", "amment"), ("emment", "emment"), ("ment", "ment ments"),
)
_FR_I = frozenset("ira ie isse issante i irai ir iras ies îmes isses issantes îtes is irais issais irions issions irons issons issants it irait issait issant iraIent issaIent irent issent iront ît iriez issiez irez issez".split())
_FR_VERB = _table(("ions", "ions"), ("er", "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"), ("a", "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"))


def french(w: str) -> str:
    vowels = "aeiouyâàëéêèïîôûù"
    v = f"[{vowels}]"

    def mark(m):
        x = m[0]
        if x[0] == "q" or len(x) == 2 and x[1] == "y" and x[0] in vowels:
            return x[0] + x[1].upper()
        return x[0].upper() + x[1] if len(x) == 2 else x[0] + x[1].upper() + x[2]

    w = re.sub(f"{v}[ui]{v}|{v}y|y{v}|qu", mark, w)
    r1, r2 = _regions(w, vowels)
    rv = len(w)
    if re.match(f"{v}{v}.", w) or re.match("par|col|tap", w):
        rv = 3
    elif m := re.compile(v).search(w, 1):
        rv = m.end()
    before, done = w, False
    kind = _FR_STANDARD.get(s := _last(w, _FR_STANDARD) or "")
    at = len(w) - len(s)
    or_else = lambda w, x, to: _drop(w, x, r2) if len(w) - len(x) >= r2 else _cut(w, x, to)
    if kind == "delete" and at >= r2:
        w, done = w[:at], True
    elif kind == "ation" and at >= r2:
        w, done = w[:at], True
        if w.endswith("ic"):
            w = or_else(w, "ic", "iqU")
    elif kind in ("log", "u", "ent") and at >= r2:
        w, done = w[:at] + kind, True
    elif kind == "ement" and at >= rv:
        w, done = w[:at], True
        x = _last(w, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
        if x == "iv" and len(w) - 2 >= r2:
            w = _drop(w[:-2], "at", r2)
        elif x == "eus":
            w = w[:-3] if len(w) - 3 >= r2 else w[:-3] + "eux" if len(w) - 3 >= r1 else w
        elif x in ("abl", "iqU"):
            w = _drop(w, x, r2)
        elif x in ("ièr", "Ièr") and len(w) - 3 >= rv:
            w = w[:-3] + "i"
    elif kind == "ité" and at >= r2:
        w, done = w[:at], True
        x = _last(w, ("abil", "ic", "iv"))
        if x == "abil":
            w = or_else(w, x, "abl")
        elif x == "ic":
            w = or_else(w, x, "iqU")
        elif x:
            w = _drop(w, x, r2)
    elif kind == "ive" and at >= r2:
        w, done = w[:at], True
        if w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
            if w.endswith("ic"):
                w = or_else(w, "ic", "iqU")
    elif kind == "eaux":
        w, done = w[:-1], True
    elif kind == "aux" and at >= r1:
        w, done = w[:at] + "al", True
    elif kind == "euse" and at >= r1:
        w, done = w[:at] + ("" if at >= r2 else "eux"), True
    elif kind == "issement" and at >= r1 and at and w[at - 1] not in vowels:
        w, done = w[:at], True
    elif kind in ("amment", "emment") and at >= rv:
        w = w[:at] + ("ant" if kind == "amment" else "ent")  # verb endings are still looked for
    elif kind == "ment" and at and w[at - 1] in vowels and at - 1 >= rv:
        w = w[:at]
    if not done:
        s = _last(w, _FR_I, rv)
        if s and len(w) - len(s) - 1 >= rv and w[len(w) - len(s) - 1] not in vowels:
            w, done = _cut(w, s), True
    if not done:
        kind = _FR_VERB.get(s := _last(w, _FR_VERB, rv) or "")
        if kind and (kind != "ions" or len(w) - 4 >= r2):
            w, done = _cut(w, s), True
            if kind == "a":
                w = _drop(w, "e", rv)
    if done:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        s = _last(w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), rv)
        if s == "ion":
            if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif s == "e":
            w = w[:-1]
        elif s == "ë":
            w = w[:-1] if w.endswith("guë") and len(w) - 3 >= rv else w
        elif s:
            w = _cut(w, s, "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    if m := re.search(f"[éè][^{vowels}]+$", w):
        w = w[: m.start()] + "e" + w[m.start() + 1 :]
    return w.lower() if before != before.lower() or w != w.lower() else w


def _adverb(w: str, suffix: str, r2: int, inner: tuple[str, ...]) -> str:
    """After an adverb's ending: drop one inner suffix in R2, and ``at`` before ``iv``."""
    w = _cut(w, suffix)
    x = _last(w, inner)
    if x and len(w) - len(x) >= r2:
        w = _cut(w, x)
        if x == "iv":
            w = _drop(w, "at", r2)
    return w


_ES_PRONOUN = frozenset("me se sela selo selas selos la le lo las les los nos".split())
_ES_STANDARD = _table(
    ("delete", "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"), ("ic", "adora ador ación adoras adores aciones ante antes ancia ancias"), ("log", "logía logías"),
    ("u", "ución uciones"), ("ente", "encia encias"), ("amente", "amente"), ("mente", "mente"), ("idad", "idad idades"), ("iva", "iva ivo ivas ivos"),
)
_ES_Y = frozenset("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
_ES_VERB = _table(("gu", "en es éis emos"), ("delete", "aba ada ida ara iera ía aría ería iría ad ed id ase iese aste iste an aban aran ieran ían arían erían irían asen iesen aron ieron arán erán irán ado ido ando iendo ar er ir as abas adas idas aras ieras ías arías erías irías ases ieses abais arais ierais íais aríais eríais iríais aseis ieseis asteis isteis áis aréis eréis iréis ados idos amos ábamos áramos iéramos íamos aríamos eríamos iríamos aremos eremos iremos ásemos iésemos imos arás erás irás ís ará erá irá aré eré iré ió"))
_ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(w: str) -> str:
    vowels = "aeiouáéíóúü"
    r1, r2 = _regions(w, vowels)
    rv = _verb_region(w, vowels)
    if p := _last(w, _ES_PRONOUN):
        rest = _cut(w, p)
        x = _last(rest, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if x and len(rest) - len(x) >= rv:
            if x != "yendo" or rest.endswith("uyendo"):
                w = _cut(rest, x, x.translate(_ACUTE))
    kind = _ES_STANDARD.get(s := _last(w, _ES_STANDARD) or "")
    at, done = len(w) - len(s), False
    if kind == "amente" and at >= r1:
        w, done = _adverb(w, s, r2, ("iv", "os", "ic", "ad")), True
    elif kind and kind != "amente" and at >= r2:
        w, done = w[:at], True
        if kind in ("log", "u", "ente"):
            w += kind
        elif kind == "ic":
            w = _drop(w, "ic", r2)
        elif kind == "iva":
            w = _drop(w, "at", r2)
        elif kind in ("mente", "idad"):
            x = _last(w, ("ante", "able", "ible") if kind == "mente" else ("abil", "ic", "iv"))
            w = _drop(w, x, r2) if x else w
    if not done and (s := _last(w, _ES_Y, rv)) and _cut(w, s).endswith("u"):
        w, done = _cut(w, s), True
    if not done and (s := _last(w, _ES_VERB, rv)):
        w = _cut(w, s)
        if _ES_VERB[s] == "gu" and w.endswith("gu"):
            w = w[:-1]
    s = _last(w, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s and len(w) - len(s) >= rv:
        w = _cut(w, s)
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


_IT_PRONOUN = frozenset("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split())
_IT_STANDARD = _table(
    ("delete", "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"), ("ic", "azione azioni atore atori"), ("log", "logia logie"), ("u", "uzione uzioni usione usioni"),
    ("ente", "enza enze"), ("amento", "amento amenti imento imenti"), ("amente", "amente"), ("ità", "ità"), ("iva", "ivo ivi iva ive"),
)
_IT_VERB = frozenset("isca enda ata ita uta ava eva iva erebbe irebbe isce ende are ere ire asse ate avate evate ivate ete erete irete ite ereste ireste ute erai irai isci endi erei irei assi ati iti eresti iresti uti avi evi ivi isco ando endo Yamo iamo avamo evamo ivamo eremo iremo assimo ammo emmo eremmo iremmo immo ano iscano avano evano ivano eranno iranno ono iscono arono erono irono erebbero irebbero assero essero issero ato ito uto avo evo ivo ar ir erà irà erò irò".split())


def italian(w: str) -> str:
    vowels = "aeiouàèìòù"
    w = w.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = re.sub(f"([{vowels}])([ui])([{vowels}])", lambda m: m[1] + m[2].upper() + m[3], w)
    r1, r2 = _regions(w, vowels)
    rv = _verb_region(w, vowels)
    if p := _last(w, _IT_PRONOUN):
        rest = _cut(w, p)
        x = _last(rest, ("ando", "endo", "ar", "er", "ir"))
        if x and len(rest) - len(x) >= rv:
            w = rest if x in ("ando", "endo") else rest + "e"
    kind = _IT_STANDARD.get(s := _last(w, _IT_STANDARD) or "")
    at, done = len(w) - len(s), False
    if kind == "amente":
        if at >= r1:
            w, done = _adverb(w, s, r2, ("iv", "os", "ic", "abil")), True
    elif kind == "amento":
        if at >= rv:
            w, done = w[:at], True
    elif kind and at >= r2:
        w, done = w[:at], True
        if kind in ("log", "u", "ente"):
            w += kind
        elif kind == "ic":
            w = _drop(w, "ic", r2)
        elif kind == "ità":
            x = _last(w, ("abil", "ic", "iv"))
            w = _drop(w, x, r2) if x else w
        elif kind == "iva" and w.endswith("at") and len(w) - 2 >= r2:
            w = _drop(w[:-2], "ic", r2)
    if not done and (s := _last(w, _IT_VERB, rv)):
        w = _cut(w, s)
    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = _drop(w[:-1], "i", rv)
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


_PT_STANDARD = _table(
    ("delete", "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"), ("log", "logia logias"), ("u", "uça~o uço~es"), ("ente", "ência ências"),
    ("amente", "amente"), ("mente", "mente"), ("idade", "idade idades"), ("iva", "iva ivo ivas ivos"), ("ira", "ira iras"),
)
_PT_VERB = frozenset("ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias aras eras iras avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis areis ereis ireis áreis éreis íreis ásseis ésseis ísseis áveis íeis aríeis eríeis iríeis ados idos amos áramos éramos íramos ávamos íamos aríamos eríamos iríamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos ámos arás erás irás eu iu ou ará erá irá".split())


def portuguese(w: str) -> str:
    vowels = "aeiouáéíóúâêô"
    w = w.replace("ã", "a~").replace("õ", "o~")
    r1, r2 = _regions(w, vowels)
    rv = _verb_region(w, vowels)
    kind = _PT_STANDARD.get(s := _last(w, _PT_STANDARD) or "")
    at, done = len(w) - len(s), False
    if kind == "amente":
        if at >= r1:
            w, done = _adverb(w, s, r2, ("iv", "os", "ic", "ad")), True
    elif kind == "ira":
        if at >= rv and w[:at].endswith("e"):
            w, done = w[:at] + "ir", True
    elif kind and at >= r2:
        w, done = w[:at], True
        if kind in ("log", "u", "ente"):
            w += kind
        elif kind == "iva":
            w = _drop(w, "at", r2)
        elif kind in ("mente", "idade"):
            x = _last(w, ("ante", "avel", "ível") if kind == "mente" else ("abil", "ic", "iv"))
            w = _drop(w, x, r2) if x else w
    if not done and (s := _last(w, _PT_VERB, rv)):
        w, done = _cut(w, s), True
    if done:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        s = _last(w, ("os", "a", "i", "o", "á", "í", "ó"))
        w = _drop(w, s, rv) if s else w
    if w.endswith("ç"):
        w = w[:-1] + "c"
    elif w.endswith(("e", "é", "ê")) and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    return w.replace("a~", "ã").replace("o~", "õ")


_RO_0 = _table(("", "ul ului"), ("a", "aua"), ("e", "ea ele elor"), ("i", "ii iua iei iile iilor ilor"), ("ile", "ile"), ("at", "atei"), ("aţi", "aţie aţia"))
_RO_COMBO = _table(
    ("abil", "abilitate abilitati abilităi abilităţi"), ("ibil", "ibilitate"), ("iv", "ivitate ivitati ivităi ivităţi"), ("ic", "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală"),
    ("at", "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători"), ("it", "itiv itiva itive itivi itivă iţiune itoare itor itori"),
)
_RO_STANDARD = _table(("", "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă"), ("ţ", "iune iuni"), ("ist", "ism isme ist ista iste isti istă işti"))
_RO_VERB = _table(
    ("u", "ea ia esc ăsc ind ând are ere ire âre ase ise use âse eşte ăşte eze ai eai iai eşti ăşti ui ezi aşi aseşi iseşi useşi âseşi işi uşi âşi âi eaţi iaţi arăţi aserăţi iserăţi userăţi âserăţi irăţi urăţi ârăţi am eam iam asem isem usem âsem arăm aserăm iserăm userăm âserăm irăm urăm ârăm au eau iau indu ându ez ească ară aseră iseră useră âseră iră ură âră ează"),
    ("", "se sese sei seşi seseşi aţi eţi iţi serăţi seserăţi âţi em sesem im ăm serăm seserăm âm seră seseră"),
)


def romanian(w: str) -> str:
    vowels = "aeiouâîă"
    w = re.sub(f"([{vowels}])([ui])([{vowels}])", lambda m: m[1] + m[2].upper() + m[3], w)
    r1, r2 = _regions(w, vowels)
    rv = _verb_region(w, vowels)
    s = _last(w, _RO_0)
    if s and len(w) - len(s) >= r1 and (s != "ile" or not w.endswith("abile")):
        w = _cut(w, s, "i" if s == "ile" else _RO_0[s])
    removed = False
    while (s := _last(w, _RO_COMBO)) and len(w) - len(s) >= r1:
        w, removed = _cut(w, s, _RO_COMBO[s]), True
    s = _last(w, _RO_STANDARD)
    if s and len(w) - len(s) >= r2:
        if _RO_STANDARD[s] != "ţ":
            w, removed = _cut(w, s, _RO_STANDARD[s]), True
        elif _cut(w, s).endswith("ţ"):
            w, removed = _cut(w, "ţ" + s, "t"), True
    if not removed and (s := _last(w, _RO_VERB, rv)):
        at = len(w) - len(s)
        if not _RO_VERB[s] or at - 1 >= rv and (w[at - 1] not in vowels or w[at - 1] == "u"):
            w = w[:at]
    s = _last(w, ("e", "i", "ie", "a", "ă"))
    w = _drop(w, s, rv) if s else w
    return w.replace("I", "i").replace("U", "u")


# ---------------------------------------------------------------- Russian

_RU_GERUND = _table(("а", "в вши вшись"), ("", "ив ивши ившись ыв ывши ывшись"))
_RU_ADJECTIVE = frozenset("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
_RU_PARTICIPLE = _table(("а", "ем нн вш ющ щ"), ("", "ивш ывш ующ"))
_RU_VERB = _table(("а", "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"), ("", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"))
_RU_NOUN = frozenset("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())


def russian(w: str) -> str:
    vowels = "аеиоуыэюя"
    m = re.search(f"[{vowels}]", w)
    if not m:
        return w
    rv = m.end()
    r2 = _after(w, vowels, _after(w, vowels))

    def either(w: str, table: dict[str, str]) -> str | None:
        """The word without its longest ending; some endings only after а or я."""
        s = _last(w, table, rv)
        if s is None or table[s] and not (len(w) - len(s) - 1 >= rv and w[len(w) - len(s) - 1] in "ая"):
            return None
        return _cut(w, s)

    if (x := either(w, _RU_GERUND)) is not None:
        w = x
    else:
        s = _last(w, ("ся", "сь"), rv)
        w = _cut(w, s) if s else w
        if s := _last(w, _RU_ADJECTIVE, rv):
            w = _cut(w, s)
            x = either(w, _RU_PARTICIPLE)
            w = w if x is None else x
        elif (x := either(w, _RU_VERB)) is not None:
            w = x
        elif s := _last(w, _RU_NOUN, rv):
            w = _cut(w, s)
    w = _drop(w, "и", rv)
    s = _last(w, ("ост", "ость"), rv)
    w = _drop(w, s, r2) if s else w
    s = _last(w, ("ейш", "ейше", "н", "ь"), rv)
    if s in ("ейш", "ейше"):
        w = _cut(w, s)
        s = "н" if w.endswith("нн") and len(w) - 2 >= rv else None
    elif s == "н":
        s = "н" if w.endswith("нн") and len(w) - 2 >= rv else None
    return _cut(w, s) if s else w


# ---------------------------------------------------------------- Uralic

_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
_FI_CASE = frozenset("lla na ssa ta lta sta lle ine ksi llä nä ssä tä ltä stä seen den tten siin han hen hin hon hän hön n a ä tta ttä".split())


def finnish(w: str) -> str:
    v1, v2, consonants = "aeiouyäö", "aeiouäö", "bcdfghjklmnpqrstvwxz"
    p1, p2 = _regions(w, v1)
    s = _last(w, ("pa", "kaan", "han", "kin", "hän", "kään", "ko", "pä", "kö", "sti"), p1)
    if s:
        rest = _cut(w, s)
        if len(rest) >= p2 if s == "sti" else rest and rest[-1] in v1 + "nt":
            w = rest
    s = _last(w, ("si", "ni", "nsa", "nsä", "mme", "nne", "an", "än", "en"), p1)
    if s:
        rest = _cut(w, s)
        if s == "si":
            w = w if rest.endswith("k") else rest
        elif s == "ni":
            w = rest[:-3] + "ksi" if rest.endswith("kse") else rest
        elif s in ("an", "än", "en"):
            w = rest if rest.endswith({"an": ("ta", "ssa", "sta", "lla", "lta", "na"), "än": ("tä", "ssä", "stä", "llä", "ltä", "nä"), "en": ("lle", "ine")}[s]) else w
        else:
            w = rest
    removed = False
    vi = lambda x: len(x) > 1 and x[-1] == "i" and x[-2] in v2
    s, table = _last(w, _FI_CASE, p1), _FI_CASE
    if s in ("den", "tten", "siin") and not vi(_cut(w, s)) or s == "seen" and not _cut(w, s).endswith(_FI_LONG):
        table = _FI_CASE - {"den", "tten", "siin", "seen"}
        s = _last(w, table, p1)
    if s:
        rest = _cut(w, s)
        if len(s) == 3 and s[0] == "h" and s[2] == "n":
            removed = rest.endswith(s[1])
        elif s in ("a", "ä"):
            removed = len(rest) > 1 and rest[-1] in v1 and rest[-2] in consonants
        elif s in ("tta", "ttä"):
            removed = rest.endswith("e")
        else:
            removed = True
            if s == "n" and rest.endswith((*_FI_LONG, "ie")):
                rest = rest[:-1]
        w = rest if removed else w
    s = _last(w, ("mma", "mpa", "mmi", "mpi", "mmä", "mpä", "impi", "impa", "immi", "imma", "impä", "immä", "eja", "ejä"), p2)
    if s and (len(s) != 3 or s[0] == "e" or not _cut(w, s).endswith("po")):
        w = _cut(w, s)
    if removed:
        w = w[:-1] if _last(w, ("i", "j"), p1) else w
    elif w.endswith("t") and len(w) - 2 >= p1 and len(w) > 1 and w[-2] in v1:
        w = w[:-1]
        s = _last(w, ("mma", "imma"), p2)
        if s and (s == "imma" or not _cut(w, s).endswith("po")):
            w = _cut(w, s)
    if _last(w, _FI_LONG, p1):
        w = w[:-1]
    if len(w) - 2 >= p1 and w[-1:] and w[-1] in "aäei" and w[-2] in consonants:
        w = w[:-1]
    if w.endswith(("oj", "uj")) and len(w) - 2 >= p1:
        w = w[:-1]
    if w.endswith("jo") and len(w) - 2 >= p1:
        w = w[:-1]
    if m := re.search(f"[^{v1}](?=[{v1}]*$)", w):
        at = m.start()
        if at and w[at - 1] == w[at]:
            w = w[:at] + w[at + 1 :]
    return w


_HU_DOUBLE = ("bb", "cc", "dd", "ff", "gg", "jj", "kk", "ll", "mm", "nn", "pp", "rr", "ccs", "ss", "zzs", "tt", "vv", "ggy", "lly", "nny", "tty", "ssz", "zz")
_HU_CASE = frozenset("ba ra be re ig nak nek val vel ul ből ről től nál nél ból ról tól ül n an ban en ben képpen on ön képp kor t at et ként anként enként onként ot ért öt hez hoz höz vá vé".split())
_HU_OTHER = {"astul": "", "estül": "", "stul": "", "stül": "", "ástul": "a", "éstül": "e"}
_HU_OWNED = {"aké": "", "eké": "", "oké": "", "öké": "", "éké": "e", "áké": "a", "ké": "", "ééi": "e", "áéi": "a", "éi": "", "éé": "e", "é": ""}


def _hu(words: str) -> dict[str, str]:
    """Endings; those that begin with a long vowel leave it short."""
    return {s: {"á": "a", "é": "e"}.get(s[0], "") for s in words.split()}


_HU_SINGLE = _hu("unk ünk ánk énk nk ájuk éjük juk jük uk ük am em om ám ém m ad ed od öd ád éd d ja je a e o á é")
_HU_MANY = _hu("jaim jeim áim éim aim eim im jaid jeid áid éid aid eid id jai jei ái éi ai ei i jaink jeink aink eink áink éink jeitek ink jaitok eitek aitok áitok éitek itek jaik jeik aik eik áik éik ik")
_HU_PLURAL = _hu("ák ék ök ak ok ek k")


def hungarian(w: str) -> str:
    vowels = "aeiouáéíóöőúü"
    if not w:
        return w
    if w[0] in vowels:
        m = re.compile(f"[^{vowels}]").search(w)
        if not m:
            r1 = len(w)
        else:
            d = re.compile("dzs|cs|gy|ly|ny|sz|ty|zs").match(w, m.start())
            r1 = d.end() if d else m.start() + 1
    else:
        m = re.search(f"[{vowels}]", w)
        r1 = m.end() if m else len(w)

    def by(w: str, table) -> str | None:
        s = _last(w, table)
        return s if s and len(w) - len(s) >= r1 else None

    def doubled(w: str, endings) -> str:
        s = by(w, endings)
        if s and (rest := _cut(w, s)).endswith(_HU_DOUBLE):
            return rest[:-2] + rest[-1]
        return w

    w = doubled(w, ("al", "el"))
    if s := by(w, _HU_CASE):
        w = _cut(w, s)
        if w.endswith(("á", "é")) and len(w) - 1 >= r1:
            w = w[:-1] + {"á": "a", "é": "e"}[w[-1]]
    for table in ({"én": "e", "án": "a", "ánként": "a"}, _HU_OTHER):
        if s := by(w, table):
            w = _cut(w, s, table[s])
    w = doubled(w, ("á", "é"))
    for table in (_HU_OWNED, _HU_SINGLE, _HU_MANY, _HU_PLURAL):
        if s := by(w, table):
            w = _cut(w, s, table[s])
    return w


ALGORITHMS = {f.__name__: f for f in (arabic, danish, dutch, finnish, french, german, hungarian, italian, norwegian, portuguese, romanian, russian, spanish, swedish, turkish)}
ALIASES = {
    "da": "danish", "dan": "danish", "nl": "dutch", "nld": "dutch", "dut": "dutch", "fi": "finnish", "fin": "finnish", "fr": "french", "fra": "french", "fre": "french", "de": "german", "deu": "german", "ger": "german",
    "hu": "hungarian", "hun": "hungarian", "it": "italian", "ita": "italian", "no": "norwegian", "nor": "norwegian", "pt": "portuguese", "por": "portuguese", "ro": "romanian", "ron": "romanian", "rum": "romanian",
    "ru": "russian", "rus": "russian", "es": "spanish", "esl": "spanish", "spa": "spanish", "sv": "swedish", "swe": "swedish", "tr": "turkish", "tur": "turkish", "ar": "arabic", "ara": "arabic",
}
