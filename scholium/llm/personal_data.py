"""Problem 10: personal data in free text, replaced by typed placeholders.

A skip-chain conditional random field over the candidate tokens of each document. Candidates are stretches that could be
an e-mail address, a number, an address or a name, whatever stands beside them: every surname with one or two Han after it,
every run of capitalised words, and every repeat of a part of one. Unary potentials come from the shape of a candidate and
the words beside it, chain potentials join neighbouring candidates, and skip potentials join distant candidates that
repeat or resemble each other (the same text, the same surname), so that one telling context labels them all. Loopy sum-product
message passing runs over all documents of an Arrow batch at once until no message changes by more than TOLERANCE; documents
that have come to rest are left out of further rounds.

All potentials are trained together on the driver, on TRAIN_DOCUMENTS documents that a seeded generator writes with their
labels (pii_training.py): first by pseudo-likelihood, then by the gradient of the likelihood under the same message
passing. No corpus row is used. Nothing is shuffled, and whole texts are read.

Defined results: null stays null, blank and clean texts stay as they are; repeated rows give repeated rows; extra columns are
kept; an empty table gives no rows; of candidates that overlap the surer one counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: "short" is a Han name that ends one character before its candidate does.
LABELS = ("none", "name", "email", "phone", "id_number", "address", "short")
SHORT = LABELS.index("short")
TRAIN_DOCUMENTS = 2_000
#: Weights are kept in a table of this many rows; features are hashed into it.
TABLE = 1 << 15
TOLERANCE = 1e-3
#: From this round on the step shrinks by a tenth a round, so that messages which swing come to rest.
STEADY = 40
# Chinese surnames, frequent ones and rare ones.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
    "亓仉乜弭昝笪逄阚缑麴郗闻佘佴儡冼厍哈夔宓寇尉岑巩庞应康戚操晏殷池沙洪涂温瞿祁祝穆符管简米翁耿艾芦苗茅蒙蓝裴褚詹赖路车辛连邢邬郁郎金钮门阎雍靳项饶骆鲍鹿黑齐"
)
DOUBLE = "欧阳 太史 上官 司马 东方 独孤 南宫 夏侯 诸葛 尉迟 皇甫 公孙 慕容 司徒 令狐".split()

_wide = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2009: 0x20}
for _keep in "，。；：！？（）":
    _wide.pop(ord(_keep), None)
_AT = r"\s?(?:@|\(a\)|\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s))\s?"
_DOT = r"(?:\.|\s?[\[({]dot[\])}]\s?|\s?[\[({]punkt[\])}]\s?)"
_email = re.compile(rf"(?:mailto:)?[A-Za-z0-9._%+\-]*[A-Za-z0-9_%+\-]{_AT}(?:[A-Za-z0-9\-]+{_DOT})+[A-Za-z]{{2,}}(?![A-Za-z0-9])")
_maybe_email = re.compile(r"@|[\[({]at?[\])}]|\bdot\b")
_maybe_address = re.compile(r"Street|Road|Lane|Avenue|\bAve\b|\bRd\b|\bSt\b|Drive|Close|Way|Court|Square|Terrace|Crescent|Box \d|rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route|weg \d|stra(?:ß|ss)e|str\.|gasse|platz|allee|ring \d|damm|ufer|Postfach|Boîte|BP|B\.P\.")
_web = re.compile(r"(?:https?://|www\.)[^\s，。；）)]+|doi:\S+", re.IGNORECASE)
_number = re.compile(
    r"(?<![A-Za-z0-9.√])(?=[\d ()（）./\-–‑+]{6})(?:\+\s?|[(（]\+?)?\d(?:[\d ()（）./\-–‑]*[\d])?[Xx]?(?:\s?(?:ext\.?|转|分机|Durchwahl|poste|x)\s?\d{1,5})?(?![A-Za-z0-9%])"
    r"|(?<![A-Za-z0-9])(?=[A-Z0-9]*\d[A-Z0-9]*)(?:[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z]\d[A-Z]{2}\d{5}|[A-Z0-9]{9,10})(?![A-Za-z0-9\-])"
)
_zh_address = re.compile(
    r"(?:路|街|大道|小区|村|巷|胡同|里|弄)(?:\d{1,5}(?:号楼|号院|号|组|栋|弄|幢|座|单元|室|楼|层))+(?:\d{1,5}(?:室|号|单元)?)?"
)
_han_run = re.compile(r"[一-鿿]{1,40}$")
_address_cue = re.compile(r"住|在|到|至|往|于|为|是|址|寄(?:给|去|回)?|送(?:给|去|回)?|搬|去|居")
_CAP = r"[A-ZÀ-ÖØ-ÞŒŠŽ]"
_W = rf"{_CAP}[\w’'\-]+"
_latin_address = re.compile(
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) \w+, )?\d{{1,4}}[A-Z]?(?: bis| ter)?,? (?:{_W} ){{1,3}}(?:Street|Road|Lane|Avenue|Ave\.?|Rd\.?|St\.?|Drive|Close|Way|Court|Square|Terrace|Crescent)(?![a-z])(?:, (?:Apt\.? ?\w+|{_W}(?: {_W})?(?: \d{{4,5}})?))*"
    rf"|P\.? ?O\.? Box \d+(?:, {_W}(?: {_W})?)?(?:, [A-Z]{{2}} \d{{4,5}})?"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route)(?: (?:de|du|des|la|le|l’)){{0,2}} ?{_W}(?: {_W})?(?:, (?:\d{{5}} )?{_W}(?:[ -]{_W})*)?"
    rf"|{_CAP}[\wäöüß\-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer) \d{{1,4}} ?[a-z]?(?![a-z\d])(?:, (?:D-)?\d{{4,5}} {_W})?"
    rf"|(?:Postfach|Boîte postale|BP|B\.P\.) \d{{2,6}}(?:, \d{{5}} {_W})?"
)
_INITIAL = rf"{_CAP}\."
_TITLES = "Dr|Prof|Mr|Mrs|Ms|Mme|Mlle|Herrn|Herr|Frau|Monsieur|Madame|Docteur|Professor|Nurse|Patientin|Patiente|Patient|Sister|Doktor|Gezeichnet|Signed|Signé|Contact|Thanks"
_latin_name = re.compile(
    rf"(?<![\w’'\-.@])(?!(?:{_TITLES})\b)(?:{_W},[ ]{_W}(?:[ ]{_INITIAL})?|{_W}(?:[ ]{_INITIAL}){{1,2}}[ ]{_W}(?:[ ]{_W})?|(?:{_INITIAL}[ ]?){{1,2}}{_W}|{_W}[ ]{_W}(?:[ ]{_W})?|{_W})(?![\w@])"
)
_titles = re.compile(rf"(?:{_TITLES})\.?$")
_PARTICLE = "的是不了在有为以于与及其他等该此这那第时后或并也都而就将又已还"
#: A surname and two Han (or one, where no second follows that could be part of a name).
_zh_name = re.compile(rf"(?=((?:{'|'.join(DOUBLE)}|[{SURNAMES}])(?![{_PARTICLE}])[一-鿿](?:(?![{_PARTICLE}])[一-鿿·])?))")
#: A name that isn't of the surnames above, after a word that a name follows.
_zh_odd = re.compile(rf"(?:患者|病人|姓名|签名|联系人|记录人|登记人|负责人)[:： ]?((?:(?![{_PARTICLE}])[一-鿿]){{2,3}})(?![一-鿿])")
_stop = set(
    "the in as by this older all when under about comparing blood draw students send contact call write staining each every at an a see of for it inflammation removal their if as long "
    "die der das den dem ein eine nach über sinkt häufig unter zeichnen ältere sämtliche ähnliche täglich für "
    "le la les un une des du de à chez cette si après toutes une dessinez chaque".split()
)
# Last words of a capitalised run that names a thing, and given names that are met often.
_HEADS = set("apparatus syndrome disease index protocol reaction test unit units street university hospital institute press journal society effect law method museum river stage bridge school college company committee department office rules parts cells types table chapter figure section schedule meeting system station method theory theorem equation scale score sign line loop body bodies cell tissue organ gland agreement act award prize report review study trial guide manual atlas receptor receptors valve engine engines krankheit syndrom zeichen test verfahren methode effekt reaktion zeitung maladie syndrome signe réaction méthode effet théorème loi musée".split())
_GIVEN = set("maria anna emma laura julia sarah lisa nina eva clara paul john peter thomas michael david daniel martin lukas jonas louis hugo jean pierre claire camille sophie marc luc wei li ming jing ahmed fatima carlos ana luis ivan olga yuki kenji priya omar elena james robert mary linda susan karl hans".split())
_wordish = re.compile(r"[A-Za-zÀ-ÿŒœ’]+|[一-鿿]|\d+|[^\s\w]")


def narrow(text: str) -> str:
    """Full-width forms as ASCII, one character for one, so that offsets stay."""
    return text if text.isascii() else text.translate(_wide)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Candidate tokens of a narrowed text, in order, without overlaps; earlier shapes win."""
    taken: list[tuple[int, int]] = []
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, shape: str) -> bool:
        k = bisect_left(taken, (end,))  # kept in order and apart
        if start < end and (not k or taken[k - 1][1] <= start):
            insort(taken, (start, end))
            if shape != "web":
                found.append((start, end, shape))
            return True
        return False

    if _maybe_email.search(text):
        for match in _email.finditer(text):
            add(*match.span(), "email")
    if "//" in text or "www" in text:
        for match in _web.finditer(text):
            add(*match.span(), "web")
    for match in _zh_address.finditer(text):
        head = _han_run.search(text, max(0, match.start() - 16), match.start())
        if head:
            cue = list(_address_cue.finditer(head.group()))
            add(head.start() + (cue[-1].end() if cue else 0), match.end(), "zh_address")
    for match in _latin_address.finditer(text) if _maybe_address.search(text) else ():
        add(*match.span(), "address")
    for match in _number.finditer(text):
        digits = sum(c.isdigit() for c in match.group())
        if digits >= 6:
            add(*match.span(), "number")
    for match in _zh_odd.finditer(text):
        if match.group(1)[0] not in SURNAMES and match.group(1)[:2] not in DOUBLE:
            add(*match.span(1), "zh_name")
    for match in _latin_name.finditer(text) if _capital.search(text) else ():
        start, end = match.span()
        words = match.group().split()
        if match.group().isupper() and _shouted(text, start, end):
            continue
        while words and (words[0].rstrip(".,").lower() in _stop or _titles.match(words[0])):
            start += len(words[0]) + 1
            words = words[1:]
        if len(words) >= 2 or words and _titles.search(text[max(0, start - 12) : start].rstrip()):
            add(start, min(end, len(text)), "latin_name")
    parts = {text[a:b] for a, b, shape in found if shape == "latin_name"}
    parts |= {w.strip(",") for part in parts for w in part.split() if len(w) > 3 and not w.endswith(".")}
    for surface in sorted(parts, key=lambda w: (-len(w), w)):
        at = text.find(surface)
        while at >= 0:
            end = at + len(surface)
            if not text[at - 1 : at].isalnum() and not text[end : end + 1].isalnum():
                add(at, end, "latin_name")
            at = text.find(surface, end)
    if _han.search(text):  # these may overlap each other: the surer one counts in the end
        for match in _zh_name.finditer(text):
            start, end = match.span(1)
            k = bisect_left(taken, (end,))
            if not k or taken[k - 1][1] <= start:
                found.append((start, end, "zh_name"))
    return sorted(found)


def _shouted(text: str, start: int, end: int) -> bool:
    """Whether capitals go on beside a stretch in capitals: running text, no name."""
    before = _letters.findall(re.split(r"[.:;,!?\n]", text[max(0, start - 16) : start])[-1])
    after = _letters.findall(re.split(r"[.:;,!?\n]", text[end : end + 16])[0])
    return bool(before and len(before[-1]) > 2 and before[-1].isupper() or after and len(after[0]) > 1 and after[0].isupper())


_letters = re.compile(r"[^\W\d_]+")
_capital = re.compile(_CAP)
_han = re.compile("[一-鿿]")


@lru_cache(maxsize=1 << 17)
def _slot(feature: str) -> int:
    value = 2166136261
    for byte in feature.encode("utf-8", "surrogatepass"):
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return value % TABLE


# Words that tell what a number beside them is.
CUES = {
    "phone": "tel tél telefon phone call mobile handy reached erreichbar joindre appeler appelez ruf durchwahl fax contact 电话 手机 致电 拨打 来电 热线 联系",
    "id": "ssn id insured identity passport identité sécurité sociale steuer-id steuer ausweisnummer ausweis versicherung personalausweis 身份证 证件 登记信息 护照 病历 insurance licence",
    "catalogue": "isbn catalogue catalog katalog-nr katalog lot batch charge édition room plate fig figure salle planche 编目号 批号 切片 挂图 货号 型号 书号 号楼 registre no. référence réf",
    "place": "lives mail visit address home wohnhaft anschrift adresse domicile courrier 家住 地址 寄送 随访地点 住址 postal",
}
_cues = {kind: re.compile("|".join(sorted(map(re.escape, words.split()), key=len, reverse=True)), re.IGNORECASE) for kind, words in CUES.items()}


def features(text: str, start: int, end: int, shape: str) -> list[int]:
    """Slots of the features of one candidate."""
    if shape == "zh_name":
        return _han_features(text[max(0, start - 4) : start], text[start:end], text[end : end + 3])
    surface = text[start:end]
    left, right = text[max(0, start - 28) : start], text[end : end + 16]
    before = [w.lower() for w in _wordish.findall(left)]
    after = [w.lower() for w in _wordish.findall(right)]
    out = ["bias", f"s:{shape}"]
    out += [f"{shape}|l{k}:{w}" for k, w in enumerate(reversed(before[-3:]))]
    out += [f"{shape}|r{k}:{w}" for k, w in enumerate(after[:2])]
    if len(before) > 1:
        out.append(f"{shape}|ll:{before[-2]}_{before[-1]}")
    if shape == "number":
        form = re.sub(r"\d+", lambda m: str(len(m.group())), surface)
        digits = [c for c in surface if c.isdigit()]
        out += [f"n:{len(digits)}", f"f:{form}", f"p:{''.join(digits[:2])}|{len(digits)}", f"z:{''.join(digits[:4]) == '0000'}"]
        out += [f"plus:{surface.lstrip('(')[:1] == '+' or surface[:2] == '00'}", f"alpha:{any(c.isalpha() for c in surface)}", f"par:{surface[:1] in '(（'}"]
        last = {kind: max((m.end() for m in cue.finditer(left)), default=-1) for kind, cue in _cues.items()}
        nearest = max(last, key=last.get)
        out += [f"cue:{nearest if last[nearest] >= 0 else '-'}", f"cuelen:{nearest if last[nearest] >= 0 else '-'}|{len(digits)}"]
        out += [f"rcue:{kind}" for kind, cue in _cues.items() if cue.search(right)]
        if len(digits) == 18:
            out.append(f"born:{1900 <= int(''.join(digits[6:10])) <= 2025 and '01' <= ''.join(digits[10:12]) <= '12'}")
        if len(digits) == 17 and surface[-1:] in "Xx":
            out.append("born:True")
    elif shape == "latin_name":
        words = surface.replace(",", "").split()
        out += [f"w:{len(words)}", f"comma:{',' in surface}", f"init:{any(len(w) == 2 and w[1] == '.' for w in words)}", f"caps:{surface.isupper()}"]
        title = _titles.search(left.rstrip())
        out += [f"title:{bool(title)}", f"start:{not left.strip() or left.rstrip()[-1:] in '.。!?！？' or left.endswith(chr(10))}"]
        lower = [w.lower().strip(".") for w in words]
        out += [f"head:{lower[-1] in _HEADS}", f"given:{any(w in _GIVEN for w in lower)}", f"end:{lower[-1][-3:]}", f"ends:{lower[-1][-2:]}"]
        out += [f"L{len(words) > 1}:{before[-1] if before else '^'}", f"R{len(words) > 1}:{after[0] if after else '$'}", f"low:{any(w.islower() for w in words)}"]
        out.append(f"han:{bool(_han.search(left[-2:]))}{bool(_han.search(right[:2]))}")
    return [_slot(f) for f in out]


@lru_cache(maxsize=1 << 17)
def _han_features(left: str, name: str, right: str) -> list[int]:
    """Slots for a Han candidate: its characters, and what stands beside it if it is a whole name or a short one."""
    double = name[:2] in DOUBLE
    family, given = (name[:2], name[2:]) if double else (name[:1], name[1:])
    tail, after, later = name[-1], right[:1], right[:2]
    near, word = left[-1:], left[-2:]
    edge = lambda c: "^" if not c or not "一" <= c <= "鿿" else c
    out = ["han", f"hs:{family if family in SURNAMES or double else '?'}", f"hl:{len(given)}", f"hd:{double}"]
    out += [f"g:{c}" for c in given] + [f"g1:{given[:1]}", f"hl1:{edge(near)}", f"hl2:{word}", f"hl3:{left[-3:]}", f"hp:{near if edge(near) == '^' else '-'}"]
    out += [f"w1:{edge(after)}", f"w2:{later}", f"w3:{right}", f"wp:{after if edge(after) == '^' else '-'}", f"both:{edge(near) == '^'}{edge(after) == '^'}"]
    out += [f"s1:{tail}", f"s2:{tail}{after}", f"s3:{tail}{later}", f"sl:{edge(near) == '^'}|{tail}"]
    return [_slot(f) for f in out]


class Field:
    """Weights of the random field: unary (TABLE, labels), and log potentials of chain and skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def label(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The labelled spans of each text."""
        graph = Graph(texts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if graph.nodes:
            belief = self.infer(graph.score(self.unary), graph)[0]
            best = belief.argmax(1)
            sure = belief[np.arange(len(best)), best] - belief[:, 0]
            for i in np.lexsort((np.arange(len(best)), -sure)):
                if not best[i]:
                    break
                t, start, end = graph.nodes[i]
                end, kind = (end - 1, "name") if best[i] == SHORT else (end, LABELS[best[i]])
                spans = out[t]
                k = bisect_left(spans, (end,))
                if not k or spans[k - 1][1] <= start:
                    spans.insert(k, (start, end, kind))
        return out

    def infer(self, score: np.ndarray, graph: Graph) -> tuple[np.ndarray, np.ndarray]:
        """(log beliefs, last messages): synchronous sum-product message passing over all edges until they rest."""
        n, labels = score.shape
        half = len(graph.edges)
        message = np.zeros((2 * half, labels))
        if not half:
            return score, message
        source, target = np.r_[graph.edges[:, 0], graph.edges[:, 1]], np.r_[graph.edges[:, 1], graph.edges[:, 0]]
        skips = np.r_[graph.skips, graph.skips]
        chain, skip = np.exp(self.chain), np.exp(self.skip)  # both symmetric
        reverse = np.r_[np.arange(half, 2 * half), np.arange(half)]
        belief = score.copy()
        live, step, turn = np.arange(2 * half), 0.7, 0
        while len(live):
            out = belief[source[live]] - message[reverse[live]]
            out = np.exp(out - out.max(1, keepdims=True))
            by_skip = skips[live]
            new = np.empty_like(out)
            new[by_skip], new[~by_skip] = out[by_skip] @ skip, out[~by_skip] @ chain
            new = np.log(new + 1e-30)
            new -= new.max(1, keepdims=True)
            change = step * (new - message[live])
            message[live] += change
            for k in range(labels):
                belief[:, k] += np.bincount(target[live], weights=change[:, k], minlength=n)
            # a document rests when none of its messages moves any more
            moving = np.zeros(graph.texts, dtype=bool)
            moving[graph.owner[source[live[np.abs(change).max(1) > TOLERANCE]]]] = True
            live = live[moving[graph.owner[source[live]]]]
            turn += 1
            step *= 1.0 if turn < STEADY else 0.9
        return belief, message


class Graph:
    """Candidates, their features and their edges, of many texts at once."""

    def __init__(self, texts: list[str]):
        nodes, slots, heads, edges, skips = [], [], [], [], []
        for t, text in enumerate(texts):
            if not text:
                continue
            flat = narrow(text)
            some = candidates(flat)
            first = len(nodes)
            for start, end, shape in some:
                heads.append(len(slots))
                slots += features(flat, start, end, shape)
                nodes.append((t, start, end))
            for a, b, kind in links(flat, some):
                edges.append((first + a, first + b))
                skips.append(kind)
        self.texts, self.nodes = len(texts), nodes
        self.slots, self.heads = np.array(slots, dtype=np.int64), np.array(heads, dtype=np.int64)
        self.edges, self.skips = np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(skips, dtype=bool)
        self.owner = np.array([t for t, *_ in nodes], dtype=np.int64)

    def score(self, unary: np.ndarray) -> np.ndarray:
        return np.add.reduceat(unary[self.slots], self.heads, axis=0)


#: Neighbouring candidates further apart than this many characters have no chain edge.
CHAIN = 120


def links(text: str, some: list[tuple[int, int, str]]) -> list[tuple[int, int, bool]]:
    """(a, b, is it a skip edge): neighbours, and candidates with the same text or surname, each with the one before."""
    out = [(i, i + 1, False) for i in range(len(some) - 1) if some[i + 1][0] - some[i][1] <= CHAIN]
    last: dict[str, int] = {}
    for i, (start, end, shape) in enumerate(some):
        if shape == "address" or shape == "zh_address":
            continue
        if shape == "zh_name":  # with or without the last character
            keys = {"zh|" + text[start : start + 2 + (text[start : start + 2] in DOUBLE)]}
        elif shape == "latin_name":
            words = [w.strip(".,") for w in text[start:end].lower().split()]
            keys = {f"part|{w}" for w in words if len(w) > 3}
        elif shape == "number":
            keys = {"digits|" + "".join(c for c in text[start:end] if c.isalnum())}
        else:
            keys = {f"{shape}|{text[start:end].lower()}"}
        for j in sorted({last[k] for k in keys if k in last}):
            if j != i - 1 or not out or (j, i, False) not in out[j : j + 1]:
                out.append((j, i, True))
        last |= dict.fromkeys(keys, i)
    return out


def gold_labels(graph: Graph, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """The label of each candidate: of the span that begins where it does and ends with it, or about there."""
    out = np.zeros(len(graph.nodes), dtype=np.int64)
    for i, (t, start, end) in enumerate(graph.nodes):
        for a, b, kind in spans[t]:
            if kind == "name":
                if a == start and b in (end, end - 1) and (b == end or end - start == 3 or b - a > 2):
                    out[i] = LABELS.index("name") if b == end else SHORT
                elif a < end and start < b and (b - a) > 4 and min(b, end) - max(a, start) > 0.5 * (end - start):
                    out[i] = LABELS.index("name")
            elif a < end and start < b:
                out[i] = LABELS.index(kind)
    return out


@lru_cache(maxsize=1)
def train() -> Field:
    """All potentials together: AdaGrad on the pseudo-likelihood, then on the likelihood by message passing."""
    from .pii_training import documents

    made = list(documents(TRAIN_DOCUMENTS))
    graph = Graph([text for text, _ in made])
    y = gold_labels(graph, [spans for _, spans in made])
    labels, n = len(LABELS), len(graph.nodes)
    node = np.repeat(np.arange(n), np.diff(np.r_[graph.heads, len(graph.slots)]))
    wanted = np.eye(labels)[y]
    a, b = graph.edges[:, 0], graph.edges[:, 1]
    kinds = (~graph.skips, graph.skips)
    unary = np.zeros((TABLE, labels))
    pairwise = [np.zeros((labels, labels)), np.zeros((labels, labels))]
    memory = [np.full_like(unary, 1e-6), *(np.full_like(p, 1e-6) for p in pairwise)]

    def descend(error: np.ndarray, pair_errors: list[np.ndarray], rate: float) -> None:
        gradient = np.zeros_like(unary)
        error = error / n * 100
        for k in range(labels):
            gradient[:, k] = np.bincount(graph.slots, weights=error[node, k], minlength=TABLE)
        for weights, slope, square in zip((unary, *pairwise), (gradient + 3e-3 * unary, *((e + e.T) / n * 100 + 1e-3 * p for e, p in zip(pair_errors, pairwise))), memory):
            square += slope**2
            weights -= rate * slope / np.sqrt(square)

    def softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(-1, keepdims=True))
        return x / x.sum(-1, keepdims=True)

    # how many neighbours of each label a candidate has, by kind of edge
    beside = []
    for kind in kinds:
        ends, others = np.r_[a[kind], b[kind]], np.r_[b[kind], a[kind]]
        beside.append(np.bincount(ends * labels + y[others], minlength=n * labels).reshape(n, labels).astype(float))
    for _ in range(50):
        score = graph.score(unary)
        for potential, counts in zip(pairwise, beside):
            score += counts @ potential
        error = softmax(score) - wanted
        descend(error, [wanted[b[k]].T @ error[a[k]] + wanted[a[k]].T @ error[b[k]] for k in kinds], 0.3)
    for _ in range(10):
        field = Field(unary, *pairwise)
        belief, message = field.infer(graph.score(unary), graph)
        ahead, back = message[: len(a)], message[len(a) :]
        errors = []
        for potential, kind in zip(pairwise, kinds):
            joint = (belief[a[kind]] - back[kind])[:, :, None] + (belief[b[kind]] - ahead[kind])[:, None, :] + potential
            p = softmax(joint.reshape(len(joint), -1)).sum(0).reshape(labels, labels)
            errors.append(p - wanted[a[kind]].T @ wanted[b[kind]])
        descend(softmax(belief) - wanted, errors, 0.1)
    return Field(unary, *pairwise)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every span replaced by its typed placeholder."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


_SPAN = StructType([StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("pii_kind", StringType())])


def find(documents: DataFrame, column: str, redacted: str = "redacted", spans: str = "pii") -> DataFrame:
    """documents with the redacted text and the spans of personal data."""
    held = documents.sparkSession.sparkContext.broadcast(train())
    result = StructType([StructField("redacted", StringType()), StructField("spans", ArrayType(_SPAN))])

    @F.pandas_udf(result)
    def run(texts: pd.Series) -> pd.DataFrame:
        texts = texts.tolist()
        labelled = held.value.label(texts)
        rows = [
            (redact(t, s) if t else t, [{"char_start": a, "char_end": b, "pii_kind": k} for a, b, k in s]) for t, s in zip(texts, labelled)
        ]
        return pd.DataFrame(rows, columns=["redacted", "spans"])

    out = documents.withColumn("__pii", run(F.col(column)))
    return out.withColumn(redacted, F.col("__pii.redacted")).withColumn(spans, F.col("__pii.spans")).drop("__pii")


def kinds(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pii_kind): each kind of personal data in each document."""
    held = documents.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labelled = held.value.label(batch["text"].tolist())
            rows = {(k, kind) for k, spans in zip(batch["key"], labelled) for *_, kind in spans}
            yield pd.DataFrame(sorted(rows), columns=[key, "pii_kind"])

    some = documents.select(F.col(key).alias("key"), F.col(column).alias("text")).where(F.length("text") > 0)
    return some.mapInPandas(run, StructType([StructField(key, documents.schema[key].dataType), StructField("pii_kind", StringType())])).distinct()
