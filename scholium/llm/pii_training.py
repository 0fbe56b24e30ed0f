"""Labelled training texts for the random field of problem 10, written by a seeded generator.

Names, numbers and places are made up from syllables, common given names and digits. The sentences around them speak of
offices, schools, deliveries, travel and households, with and without personal data, in Chinese, English, German and
French; none of them is taken from a corpus. A third of the documents come back to a name in a sentence that could as
well be about a product or a plant of the same form: there only the other mention tells what it is.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from .personal_data import DOUBLE, SURNAMES

_SYLLABLES = "ba bel cor dan del fen gar hol ira jon kel lor mar nev oro pel quin ros sal tor ul ver wen xan yor zel".split()
_FIRST = "Maria Anna Emma Laura Julia Sarah Lisa Nina Eva Clara Paul John Peter Thomas Michael David Daniel Martin Lukas Jonas Louis Hugo Jean Pierre Claire Camille Sophie Marc Luc Wei Li Ming Jing Ahmed Fatima Carlos Ana Luis Ivan Olga Yuki Kenji Priya Omar Elena".split()
_LAST = "Smith Jones Taylor Brown Lopez Garcia Martinez Silva Zhang Wang Chen Kim Nguyen Müller Schmidt Weber Fischer Wagner Bernard Dubois Moreau Laurent Rossi Novak Ivanov Kumar Singh Sato Tanaka Khan".split()
_HAN_GIVEN = "安博晨丹恩芳刚海佳凯兰明宁鹏琪然思婷伟欣雅泽梅强洁磊娟涛敏静秀英华军平丽杰桂建国庆春燕玲志文玉云飞雪琳怡雨浩宇轩子涵嘉俊瑞晓凤莉辉斌翔成楠彬毅恒德祥小"
_HAN_PLACE = "东南西北青白云山河湖清平安乐新和福永长泰"
#: Characters that make up things which begin like a name.
_HAN_THING = "石膏金属黄疸高压温度水平方案常规严重马达车站路口江面安全程序管道白糖周期任务应用张力向量米粉毛巾钱包龙头花园叶片谢幕苏打唐装叶绿万能钟表汤匙熊猫牛奶鱼油"

#: Ordinary words, many of which hold a character that is a surname too; running text without names is made of them.
_HAN_WORDS = (
    "应该 反应 过程 程度 关于 对于 由于 于是 等于 小于 尽管 管道 血管 白天 蛋白 明白 依赖 任何 任务 责任 如何 周围 周期 一周 方向 方法 双方 向上 单独 简单 高度 提高 金属 资金 马上 安全 平安 常常 正常 严重 严格 温度 温暖 水平 和平 "
    "石头 路线 道路 车辆 汽车 江河 花朵 叶子 茶叶 章节 文章 史料 历史 段落 阶段 项目 庞大 苏醒 唐代 万一 千万 钱包 武器 余下 剩余 其余 陆地 大陆 范围 模范 米饭 毛病 羽毛 雷雨 龙头 孙子 夏天 冬天 秦代 许多 也许 何时 "
    "连接 连续 符合 符号 祝贺 穆然 齐全 整齐 黑色 黄色 蓝色 包括 包装 池塘 清洗 洪水 沙子 通过 经过 已经 受到 因为 所以 如果 但是 而且 其中 之间 以后 以前 同时 首先 其次 最后 一般 可能 必须 需要 可以 能够 进行 发生 出现 引起 "
    "增加 减少 变化 影响 作用 结果 原因 条件 情况 问题 部分 表面 内部 外部 结构 功能 系统 材料 数量 比例 浓度 压力 速度 时间 空间 颜色 形状 大小 长短 观察 研究 分析 说明 表示 认为 发现 证明 比较 相同 不同 逐渐 迅速 明显 主要"
).split()
#: {slot} is replaced by made-up data; {who} is a name or, as {thing}, something of the same form that is none.
SENTENCES = {
    "zh": (
        "乘客{name}已在柜台办好手续。|病人{name}今早退烧。|患者{name}，女，六岁。|患者{name}于昨夜离院。|患者{name}在家休息。|患者{name}自己走来。|病人{name}，女，刚退休。|病人{name}因摔倒就医。|昨日{name}来电，说要改期。|昨日{name}来取药，|今日{name}到校。|前日{name}来还书。|感谢{name}医生。|感谢{name}老师的耐心。|多谢{name}老师帮忙改稿。|昨天{name}带着孩子来了。|前天{name}来看牙。|登记人：{name}。|填表人：{name}，|签名：{name}。|座位 {d1}：{name}，到了。|{d1}床：{name}，睡着了。|负责人：{name}经理。|让{name}主任签字。"
        "|名字：{name}。|收件人：{name}，|{name}先生在楼下等你。|{name}女士问了退货的事。|护士{name}量了体温。|后来{name}好多了。|后来{name}又打来电话。|这时{name}走进教室。|{name}昨天来过两次。|{name}又迟到了。|{name}笑了。|患者{name}今晨下床走动。|病人{name}睡得很好。|出院时{name}已能走路。|{name}给我看了照片。|{name}的妈妈来接他。|因此{name}没有去。|于是{name}改签了车票。|主治医生{name}说可以出院。|班长{name}请了病假。|会计{name}在对账。|司机{name}绕了路。|{name}昨晚打电话来了。|{name}和{name}一起值夜班。|我把钥匙交给了{name}。|{name}说他明天不来。|{name}今天过生日。|刚才{name}发了消息给我。|听{name}讲，门口在修路。|这张照片是{name}拍的。"
        "|{name}老师讲完了。|{name}教授出差了。|找{name}拿票。|{name}写了两页。|会上{name}没有发言。|记录：{name}。|感谢{name}。"
        "|{who}又到了。|下午轮到{who}。|{who}排在最后。|又提到了{who}。|大家都记得{who}。|后面还有{who}。|{who}不在这里。"
        "|商品{thing}卖完了。|试剂{thing}放在冰箱。|品牌{thing}换了包装。|一种叫{thing}的香料。|型号{thing}已停产。|药材{thing}要先泡水。"
        "|手机号{phone}。|打{phone}找我。|座机 {phone}，下班没人接。|联系方式：{phone}。|订餐热线{phone}。|有事拨{phone}。|家里电话{phone}，"
        "|身份证{id_number}。|证件{id_number}，复印两份。|身份证号码是{id_number}。|旅客证件号：{id_number}。|护照号{id_number}。|户口登记 {id_number} 没有错。"
        "|搬到{address}。|快递送到{address}。|请寄{address}。|地址：{address}。|我家在{address}，|约在{address}见面。|店开在{address}。"
        "|邮箱：{email}|发到{email}就行。|写信给 {email}。|联系 {email}，"
        "|书号 {isbn}，编号 {catalogue}。|条码 {catalogue}。|批次{batch}合格。|订单号 {batch} 已发货。|第{d1}号楼停水，看{d2}页。|每次 2 mg @ 4 mL。|网址 https://www.shop.example/item/{d2} 打不开。|箱号 {catalogue}。|编号{catalogue}，|共{d2}人参加，约{d1}成同意。"
        "|白天气温高，晚上凉。|周末路上车多，应早点出门。|高铁比马车快得多，于是改乘高铁。|金属管道接口处漏水。|黄豆泡水后体积变大，程度不一。|方法见附录，任何一步都不能省。|严格按照说明书应用，向内旋紧。|石头、木材和水管都在院里，周围有栏杆。|江水上涨，河堤安全。|白糖的用量应当减少，于下锅前加入。|温度每升高一度，压力就增加一分。|常用的方程有三个，张力与长度成正比。|钱不够，任务没有完成。|马路对面是花园，车辆须绕行。|龙头一直滴水，管工明早来。|由于路滑，孙子摔了一跤。|史料记载很少，万一遗失就难补。|叶子先黄后落，苗木向阳。|何时开始不清楚，应该与季节有关。|毛巾要晒干，汤要趁热喝。|米和面放在一起，康复需要时间。|陈旧的机器噪声大，谢绝参观。|章节后附有习题，雷雨天停课。|贺卡和连环画都在架上，简单易懂。|曹操的诗选入课本。|项目分为段落，庞大而复杂。"
    ),
    "en": (
        "Please hand the keys to {name} before noon.|Ask for {name} (desk {d1}).|Our guide was Mr. {name}.|Mrs. {name} rang about the parcel.|Ms {name} teaches the morning class.|Dr. {name} is away until Monday.|Prof. {name} chairs the panel.|Nurse {name} checked the chart.|Passenger {name} missed the train.|Yours sincerely, {name}|Signed by {name}.|Signed: {name}|Many thanks to {name}, who drove.|I met {name} at the bakery.|{name} called twice yesterday.|{name} and {name} share an office.|My neighbour {name} plays the cello.|The patient {name} slept well.|Patient {name} came back on Friday.|Booked by {name}.|{name} said no.|We wrote to {name} again.|The report by {name} is late.|Name: {name}.|Mr. {last} waved.|Dr. {last} nodded.|Mrs {last} left early.|Attended by {name}."
        "|Then came {who}.|Everybody remembers {who}.|Next on the list is {who}.|After that, {who} again.|And {who} too."
        "|The new {thing} works well.|A bottle of {thing} costs nine dollars.|We flew over {thing} and landed.|The {thing} is a kind of pump.|{thing} (the brand) changed its logo.|Products such as {thing} sell fast."
        "|Ring {phone} after six.|My mobile is {phone}.|Fax: {phone}.|Phone: {phone}|You can dial {phone} at any time.|Our number is {phone}.|Tel: {phone}"
        "|His passport, {id_number}, has expired.|Social security number: {id_number}.|SSN: {id_number}|Driving licence {id_number} was renewed.|Identity card no. {id_number}.|Insured person {id_number}.|ID: {id_number}"
        "|We moved to {address}.|Deliver it to {address}.|The shop at {address} is shut.|Address: {address}|Come to {address} on Sunday.|She lives at {address} now."
        "|Drop me a line at {email}.|Email: {email}|Replies go to {email} please.|Reach us via {email}."
        "|Item {catalogue} is sold out, see ISBN {isbn}.|Order {batch} has shipped.|Batch no. {batch} passed.|Cat. no. {catalogue}.|Lot {batch}.|Part number {catalogue}.|Gate {d1}, row {d2}.|Mix 3 g @ 20 mL.|See https://shop.example.com/p/{d2} or www.example.net/{d1}.|The {eponym} effect is small.|{eponym} syndrome is rare.|We used the {eponym} method.|{eponym} and {eponym} tests agree.|{eponym}’s law holds.|Long before {eponym} disease was named, cooks knew it.|The {eponym}–{eponym} equation has two roots."
        "|The Golgi Apparatus packs proteins.|Part Two: Moving Wheels|Heat Flow Index|Type II Engines|Table Of Contents|Red Blood Cells|Annual General Meeting|New York Marathon|Central Railway Station|Basic Safety Rules|Frequently Asked Questions|Final Exam Schedule|WARNING: {caps} VALVE TYPE II|PLEASE KEEP {caps} DOORS SHUT AT NIGHT|The {eponym} Protocol was signed.|{eponym} Street is closed.|The {eponym} River floods.|Tourists love the {eponym} Museum.|Under {eponym} Law nobody pays.|Each Friday Morning they meet.|Draw Figure Nine first.|About Half of them agree.|Whether Dogs dream is unknown.|During Winter the lake freezes."
    ),
    "de": (
        "Frau {name} hat angerufen.|Herr {name} sitzt im Büro.|Den Schlüssel hat {name}.|Unterschrieben von {name}.|Gez. {name}|Gezeichnet: {name}|Dr. {name} hat Urlaub.|Der Brief an {name} kam zurück.|Patientin {name} schläft.|Patient {name} wartet.|{name} kommt später.|Mein Nachbar {name} backt Brot.|Wir danken {name} für die Hilfe.|Name: {name}.|Prof. {name} liest heute.|Frau {last} lacht."
        "|Danach kam {who}.|Alle kennen {who}.|Zuletzt war es {who}."
        "|Die Marke {thing} ist neu.|Ein Gerät namens {thing} steht hier.|Das Mittel {thing} ist teuer."
        "|Telefonnummer: {phone}.|Handy {phone}|Rufen Sie {phone} an.|Tel.: {phone}|Durchwahl {phone}."
        "|Personalausweis {id_number}.|Die Steuernummer lautet {id_number}.|Ausweis-Nr. {id_number} ist gültig.|Identifikationsnummer {id_number}.|Versichertennummer: {id_number}"
        "|Wir wohnen jetzt {address}.|Adresse: {address}|Das Paket geht an {address}.|Treffpunkt: {address}."
        "|Mail: {email}|Schreiben Sie an {email}.|Antwort bitte an {email}"
        "|Bestellung {batch} ist da.|Artikel {catalogue} fehlt.|Art.-Nr. {catalogue}.|Katalognummer {catalogue}.|Bestell-Nr. {catalogue}. |ISBN {isbn}.|Zimmer {d1}, Tisch {d2}.|Der {eponym}-Effekt ist klein.|Das {eponym}-Verfahren hilft.|Nach {eponym} benannt.|Die {eponym} Methode ist alt.|Der Zug nach Norden hat Verspätung.|Im Garten stehen Rosen und Nelken.|Am Montag Abend ist Probe.|Das Rote Kreuz sammelt.|Die Neue Zeitung berichtet.|Alle Läden sind zu.|Viele Kinder lernen Schwimmen.|Große Hunde bellen selten.|Meistens regnet es.|Jedes Kind hat Stift und Papier.|Frische Brötchen gibt es ab sechs.|Laut Plan Beginn um acht.|Typ II Motoren laufen leise.|Während Anna kocht, deckt Paul den Tisch."
    ),
    "fr": (
        "Mme {name} a téléphoné.|M. {name} habite en face.|Monsieur {name} attend.|Madame {name} est partie.|Le docteur {name} arrive.|Dr {name} est absent.|Signé {name}|Signature : {name}.|La lettre de {name} est arrivée.|Merci à {name} pour son aide.|{name} viendra demain.|Mon voisin {name} joue du piano.|Nom : {name}.|La patiente {name} dort.|Patient : {name}|Mme {last} sourit."
        "|Puis vint {who}.|Tous connaissent {who}.|Il reste {who}."
        "|La marque {thing} a changé.|Un appareil nommé {thing} est en vente.|Le produit {thing} coûte cher."
        "|Téléphone : {phone}.|Mon portable : {phone}|Appelez au {phone}.|Tél : {phone}|Composez le {phone}."
        "|Numéro de sécurité sociale : {id_number}.|Carte d’identité {id_number}.|Assuré {id_number}.|N° INSEE {id_number}"
        "|Adresse : {address}|Nous habitons {address}.|Livrez au {address}.|Rendez-vous au {address}."
        "|Mail : {email}|Écrivez-nous à {email}.|Réponse à {email}"
        "|Commande {batch} livrée.|Article {catalogue} épuisé.|Réf. {catalogue}.|Lot {batch}.|Série {batch} rappelée.|ISBN {isbn}.|Salle {d1}, table {d2}.|L’effet {eponym} est faible.|La méthode de {eponym} marche.|Le théorème de {eponym} suffit.|Loi de {eponym}.|La Poste ouvre à neuf heures.|Les Alpes du Nord sont belles.|Cet hiver la rivière gèle.|Tous les trains partent.|Chaque élève prend son cahier.|Le Monde Diplomatique paraît.|Selon Paul il pleut.|Avant Noël tout ferme.|Type II Moteurs"
    ),
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        word = "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((2, 2, 3)))).capitalize()
        return word if self.r.random() < 0.8 else word.translate(str.maketrans(dict(zip("aeou", self.r.choice(("áéóú", "äëöü", "àèôû"))))))

    def name(self, lang: str) -> str:
        r = self.r
        if lang == "zh" and r.random() < 0.92:
            surname = r.choice(DOUBLE) if r.random() < 0.05 else r.choice(SURNAMES)
            return surname + "".join(self.given() for _ in range(r.choice((1, 2, 2))))
        first = r.choice(_FIRST) if r.random() < 0.4 else self.word()
        last = r.choice((r.choice(_LAST), self.word(), self.word(), f"{self.word()}-{self.word()}", f"O’{self.word()}"))
        return r.choice((f"{first} {last}", f"{first} {last}", f"{first} {last}", f"{first[0]}. {last}", f"{first} {self.word()[0]}. {last}", f"{last}, {first}", f"{first} {last}".upper()))

    def given(self) -> str:
        """A character of a given name; four of ten are met rarely."""
        return self.r.choice(_HAN_GIVEN) if self.r.random() < 0.6 else chr(self.r.randint(0x5F00, 0x9A00))

    def thing(self, lang: str) -> str:
        r = self.r
        if lang == "zh":
            tail = (lambda: self.given()) if r.random() < 0.5 else (lambda: r.choice(_HAN_THING))
            return r.choice(SURNAMES) + "".join(tail() for _ in range(r.choice((1, 2, 2))))
        return f"{self.word()} {self.word()}"

    def phone(self, lang: str) -> str:
        r, d = self.r, self.digits
        if lang == "zh":
            m = r.choice("13 15 17 18 19".split()) + d(1)
            a, b = d(4), d(4)
            return self.wide(r.choice((f"{m}{a}{b}", f"{m}-{a}-{b}", f"{m} {a} {b}", f"+86 {m}{a}{b}", f"0086-{m}-{a}-{b}", f"0{d(3)}-{d(7)} 转 {d(2)}", f"（0{d(3)}）{d(7)}", f"0{d(2)}-{d(8)}")))
        if lang == "de":
            return r.choice((f"(0{d(2)}) {d(8)}", f"+49 {d(2)} {d(5)}-{d(3)}", f"0049/{d(2)}/{d(8)}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(7)}"))
        if lang == "fr":
            pairs = " ".join(d(2) for _ in range(4))
            return r.choice((f"+33 {r.choice('12345679')} {pairs}", f"0{r.choice('12345679')} {pairs}", f"0{r.choice('12345679')}.{pairs.replace(' ', '.')}", f"0033 {r.choice('12345679')} {pairs}"))
        return r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"{d(3)}-{d(4)} ext. {d(2)}"))

    def id_number(self, lang: str) -> str:
        r, d = self.r, self.digits
        born = f"{r.randint(1930, 2010)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
        if lang == "zh":
            area, tail = r.choice("1 2 3 4 5 6 9".split()) + d(5), d(3) + r.choice("0123456789X")
            return self.wide(r.choice((f"{area}{born}{tail}", f"{area}{born}{tail}", f"{area} {born} {tail}", f"{area}-{born}-{tail}")))
        if lang == "de":
            return r.choice((f"{d(2)} {d(3)} {d(3)} {d(3)}", f"L{d(1)}{r.choice('CFGHJKZ')}{r.choice('CFGHJKZ')}{d(5)}", d(11)))
        if lang == "fr":
            return f"{r.choice('12')} {d(2)} {r.randint(1, 12):02d} {d(2)} {d(3)} {d(3)} {d(2)}"
        return r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{r.choice('ABCXZ')}{d(7)}"))

    def wide(self, text: str) -> str:
        return text.translate({c: c + 0xFEE0 for c in range(0x30, 0x3A)}) if self.r.random() < 0.08 else text

    def address(self, lang: str) -> str:
        r, d = self.r, self.digits
        h = lambda n: "".join(r.choice(_HAN_PLACE) for _ in range(n))
        n = str(r.randint(1, 300))
        if lang == "zh":
            return r.choice((f"{h(2)}市{h(1)}川区{h(2)}路{n}号{r.randint(1, 9)}单元{r.randint(101, 990)}室", f"{h(2)}县{h(2)}镇{h(2)}村{r.randint(1, 12)}组{n}号", f"{h(2)}市{h(2)}街道{h(2)}小区{r.randint(1, 20)}栋{r.randint(101, 2901)}", f"{h(2)}大道{n}弄{r.randint(1, 30)}号", f"{h(2)}市{h(2)}街{n}号"))
        w = self.word
        if lang == "de":
            return r.choice((f"{w()}{r.choice(('weg', 'straße', 'gasse', 'platz'))} {n}, {d(5)} {w()}", f"{w()}straße {n}", f"Postfach {d(4)}, {d(5)} {w()}"))
        if lang == "fr":
            return r.choice((f"{n} bis, avenue {w()}, {w()}", f"{n}, rue {w()}, {d(5)} {w()}", f"{n} rue de {w()}, {w()}", f"BP {d(3)}, {d(5)} {w()}"))
        return r.choice((f"{n} {w()} Lane, {w()} Falls", f"Flat {r.randint(1, 30)}, {n} {w()} Road, {w()}", f"P.O. Box {n}, {w()}, ZZ {d(5)}", f"{n}B {w()} Street, Apt. {r.randint(1, 40)}, {w()} {d(5)}"))

    def email(self, lang: str) -> str:
        r, w = self.r, lambda: self.word().lower()
        local = r.choice((f"{w()}.{w()}", f"{w()[0]}_{w()}", f"{w()}{self.digits(2)}", f"{w()}-{w()[0]}", f"{w()}+ward"))
        local = local.encode("ascii", "ignore").decode()
        host, top = (x.encode("ascii", "ignore").decode() for x in (r.choice((w(), f"mail.{w()}")), r.choice("com org net test invalid".split())))
        form = r.choice((f"{local}@{host}.{top}", f"{local}@{host}.{top}", f"{local}＠{host}.{top}", f"{local} [at] {host.replace('.', ' [dot] ')} [dot] {top}", f"{local}(a){host}.{top}", f"{local} @ {host}.{top}", f"<{local}@{host}.{top}>", f"{local}@{host}.{top}".upper()))
        return form

    def other(self, slot: str, lang: str) -> str:
        r, d = self.r, self.digits
        if slot == "catalogue":
            return r.choice((f"0000{d(14)}", f"0000-{d(r.choice((3, 4)))}-{d(3)}", d(12))) if lang != "zh" else f"0000{d(14)}"
        if slot == "isbn":
            return f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"
        if slot == "batch":
            return f"20{d(6)}-{d(4)}" if lang == "zh" else f"20{d(2)}-{d(4)}-{d(r.choice((1, 2, 3, 4)))}"
        if slot == "eponym":
            return self.word()
        if slot == "run":
            return "".join(r.choice(_HAN_WORDS) if r.random() < 0.8 else r.choice("的在了与和为是从把被对中上下每各再很更最") for _ in range(r.randint(4, 14)))
        if slot == "caps":
            return self.word().upper()
        return str(r.randint(1, 10 ** int(slot[1:]) - 1))


_slot = re.compile(r"\{(\w+)\}")


def documents(n: int, seed: int = 11, unclear: bool = True) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of n made-up documents; names, numbers and things come back further down.

    Without ``unclear`` no sentence leaves open whether it speaks of a person.
    """
    make = _Maker(seed)
    r = make.r
    kinds = {"name": make.name, "phone": make.phone, "id_number": make.id_number, "address": make.address, "email": make.email}
    for _ in range(n):
        lang = r.choice(("zh", "zh", "en", "de", "fr"))
        every = [s for s in SENTENCES[lang].split("|") if unclear or "{who}" not in s]
        sentences = r.choices(every, k=r.randint(3, 9))
        if lang == "zh":
            sentences += r.choices(("{run}，{run}。", "{run}。", "{run}{d1}{run}；"), k=r.randint(1, 4))
        if unclear and r.random() < 0.35:  # somebody or something that is named twice, once without a clue
            said = r.choice(("name", "thing"))
            told = r.choice([s for s in every if "{" + said + "}" in s])
            sentences += [told, *r.choices([s for s in every if "{who}" in s], k=r.randint(1, 3))]
        else:
            said = ""
        r.shuffle(sentences)
        text, spans = "", []
        used: dict[str, str] = {}
        for sentence in sentences:
            at = 0
            for match in _slot.finditer(sentence):
                text += sentence[at : match.start()]
                at, slot = match.end(), match.group(1)
                again = slot == "who"
                if again:
                    slot = said or r.choice(("name", "thing"))
                if slot in kinds:
                    value = used[slot] if slot in used and r.random() < (0.9 if again else 0.3) else kinds[slot](lang)
                    used[slot] = value
                    spans.append((len(text), len(text) + len(value), slot))
                elif slot == "last":
                    value = r.choice(_LAST) if r.random() < 0.4 else make.word()
                    spans.append((len(text), len(text) + len(value), "name"))
                elif slot == "thing":
                    value = used[slot] if slot in used and r.random() < (0.9 if again else 0.3) else make.thing(lang)
                    used[slot] = value
                else:
                    value = make.other(slot, lang)
                text += value
            text += sentence[at:] + ("" if lang == "zh" else " ")
        yield text, spans
