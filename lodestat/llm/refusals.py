"""Answers that decline and give nothing else (part of problem 5).

Every sentence is turned into a string of word classes (speaker, negation, ability, act of answering,
rule, condition and so on), by stems in English, French, German and Spanish and by the longest entry in
Chinese. Automata over these classes, not over wordings, tell what a sentence does: it declines (a
speaker or nobody in particular, an inability or unwillingness, and an act of answering as its object),
or it only goes with that (greeting, apology, referral, offer), or it says something.
"""

from __future__ import annotations

import functools
import re

#: Word classes. A stem ends in "*"; Chinese entries are matched longest first.
#: F speaker, P verb form of the speaker, N negation, M ability, permission or will, W preference, A act or result of
#: answering, Q what may be given, G giving, D declining, X beyond, R rule or scope, B forbidding, T the thing asked, K what is
#: missing, U data as reason, C turn to advice, H greeting, apology or thanks, E who else may know,
#: Y the reader, L something else, V what the speaker is, Z Chinese inability with the speaker left out.
CLASSES = {
    "F": "i we me my our us je j nous moi mon ma mes m ich wir mir mich mein meine meinen meiner yo nosotros mi mis me 我 我們 我们 本人 本助理 在下",
    "P": "puedo podemos estoy estamos debo debemos prefiero preferimos tengo soy lamento quiero",
    "N": "not no never unable incapable nothing none neither nor impossible ne pas rien aucun aucune incapable nicht nichts kein keine keinen keinem keiner nie niemals unmöglich außerstande nunca nada ningún ninguna imposible incapaz 不 沒 没 沒有 没有 未能 別 别",
    "M": "can could may might able allow* permit* authori* position comfortable willing will would shall do does free possible supposed peux peut pouvons puis pouvoir mesure autoris* permis souhait* veux kann können könnte darf dürfen möchte* will wollen werde lage befugt berechtigt möglich erlaubt poder posible autorizad* permitid* condiciones 能 能夠 能够 可以 可 允許 允许 方便 適合 适合 願意 愿意",
    "W": "rather prefer* préfèr* lieber",
    "A": "answer* help* assist* respond* respons* repl* discuss* comment* advis* advice opinion* talk* speak* opin* weigh* guidance compl* fulfil* engag* recommendation* statement répon* aide* aider discut* comment* conseil* avis prononc* parl* exprim* antwort* beantwort* helf* weiterhelf* hilfe auskunft auskünfte äußer* äusser* kommentier* berat* rat besprech* diskutier* stellung respuest* respond* ayud* comentar* hablar opin* aconsej* consejo* asesor* 回答 答覆 答复 回覆 回复 作答 解答 評論 评论 討論 讨论 協助 协助 幫忙 帮忙 幫助 帮助 忙 處理 处理 意見 意见 看法 表態 表态 置評 置评 談論 谈论 奉告 評價 评价",
    "Q": "analys* assessment* information 建議 建议 分析 資訊 信息",
    "G": "give* given provid* offer* shar* say* express* take* make* state donn* fourni* offr* part* dire geb* gegeb* erteil* sag* nehm* mach* dar dado ofrec* decir compart* emit* 提供 給出 给出 給予 给予 表示 發表 发表",
    "D": "declin* refus* refrain* abstain* décline* refuse* abst* ablehn* lehne verweiger* enthalte rechaz* declin* abstener* 婉拒 拒絕 拒绝 謝絕 谢绝",
    "X": "outside beyond against contrary hors au-delà contre außerhalb jenseits gegen wider fuera contra 超出 違反 违反 違背 违背",
    "R": "guideline* instruction* rule* polic* programming guardrail* scope remit principle* restrict* limits règle* consigne* directive* richtlinie* regeln anweisung* vorgaben norma* regla* instruccion* política* 守則 守则 規則 规则 規定 规定 準則 准则 政策 指示 範圍 范围 權限 权限 限制",
    "B": "forbid* prohibit* prevent* bar bars interdi* empêch* verbiet* verboten untersag* hinder* prohíb* prohib* impid* 禁止",
    "T": "this that it question* request* topic* subject* matter* issue* inquiry something ceci cela cette ce demande* sujet* dies* das dazu dabei darüber hier frage* anfrage* thema themen esto eso esta pregunta* solicitud* tema asunto 這 这 此 問題 问题 題目 题目 請求 请求 主題 主题 話題 话题 事 件",
    "K": "without until unless before missing insufficient enough more further detail* which sans avant manqu* davantage ohne bevor solange fehl* mehr genug sin hasta falta* más suficiente 缺少 缺乏 不足 補充 补充 需要 說明 说明 除非 之前 先",
    "U": "data dataset sample design evidence estimate* données échantillon daten stichprobe datos muestra 資料 资料 數據 数据 樣本 样本 設計 设计",
    "C": "consult* contact* ask* seek* reach* see turn* refer* suggest* recommend* consulter contact* demand* adress* wend* frag* konsult* consult* pregunt* dirij* acud* 洽 洽詢 洽询 諮詢 咨询 詢問 询问 請教 请教 找 請 请",
    "H": "hello hi hey dear sorry apolog* regret* unfortunately sadly afraid thank* appreciat* understand* please bonjour désolé* regrett* malheureusement merci hallo leider leid entschuld* bedaur* danke* hola siento lamentablemente gracias 抱歉 對不起 对不起 遺憾 遗憾 感謝 感谢 謝謝 谢谢 您好 你好 見諒 见谅 諒解 谅解 體諒 体谅 坦白說 坦白说",
    "E": "statistician* professional* expert* specialist* analyst* consultant* counsel* colleague* supervisor* someone somebody doctor* lawyer* physician* adviser* advisor* statisticien* professionnel* spécialiste* conseiller* statistiker* fach* expert* berater* estadístic* profesional* especialista* asesor 專業人員 专业人员 專家 专家 統計人員 统计人员 人員 人员 顧問 顾问 同事 老師 老师 醫師 医师",
    "Y": "you your yours vous votre vos tu te ton sie ihnen ihr ihre ihrer usted ustedes su sus le les 你 您 你們 你们",
    "L": "else other others another different anything instead free happy glad welcome know autre autres sonst ander* etwas gern* jederzeit otro otra otros otras algo demás 其他 其它 別的 别的 另外 歡迎 欢迎 改問 改问 還有 还有 聊 希望",
    "V": "assistant* ai model* chatbot bot program* automated system ki ia asistente modelo 助理 助手 模型 人工智慧 人工智能 系統 系统",
    "Z": "無法 无法 不能 不便 不方便 不適合 不适合 恕不 恕難 恕难 恕無法 恕无法 幫不上 帮不上 不予 不宜 無可 无可 未便",
}
#: Small words that carry nothing of their own, and set phrases for declining.
SMALL = frozenset(
    "the a an of to and in is are be been being was as at on for with by from about so but if or s am has have had must need here there because since after some thought all too very really just now then also still only own to upfront honest frank "
    "le la les un une des du de et est être suis d l à en y que qui pour sur plus der die den dem des ein eine einen einem einer und ist bin zu im in auf für von mit es tut so als el los las una y es en de del por para con que al como lo "
    "的 了 在 對 对 是 和 也 就 因此 所以 但 而 內 内 上 嗎 吗 想 關於 关于 作為 作为 必須 必须 受到 到 這項 处 個 个 與 与 並 并 說 说 讓 让 方面 當地 当地 專案 统计 統計 本".split()
)
ALOOF = {"leave alone": "declin", "leave aside": "declin", "leave it alone": "declin", "steer clear": "declin", "stay out": "declin", "stay away": "declin", "pass on": "declin", "off limits": "not allowed", "off-limits": "not allowed", "can not": "can not", "weder noch": "nicht"}

_SHORT = [(re.compile(r"\bcan(?:no|')t\b"), "can not"), (re.compile(r"\bwon't\b"), "will not"), (re.compile(r"n't\b"), " not"), (re.compile(r"'(?:m|re|ve|d|ll)\b"), " ")]
_ALOOF = re.compile("|".join(rf"\b{re.escape(k)}\b" for k in ALOOF))
_PIECE = re.compile(r"[㐀-鿿]+|[A-Za-z]+-[A-Za-z]*\d\w*|[^\W\d_㐀-鿿]+(?:-[^\W\d_㐀-鿿]+)*|[A-Za-z]*[\d_][\w.-]*|[,，;；:：、]|[^\w\s]")
_HAN = re.compile(r"[㐀-鿿]")
_STOPS = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])|\n+")
_BUT = re.compile(r"\b(?:but|however|instead|mais|plutôt|aber|stattdessen|pero|sino)\b|但|不過|不过|改用|建議用|建议用")

#: Data named as something at hand, not as a topic.
_FROM_DATA = re.compile(r"\b(?:these|this|the|those|such|your|our|ces|cette|les|diese[nr]?|den|der|estos|esta|los|las) (?:[^\W\d_]+ )?(?:data|dataset|sample|design|evidence|données|échantillon|daten|stichprobe|datos|muestra)\b")

#: Automata over classes. "o" is any other word, "s" a small one, "i" an id or number, "," a pause.
_DECLINE = [
    re.compile(p)
    for p in (
        r"[FP][^,]{0,6}N(?:.{0,7}A|.{0,4}G[^,]{0,8}Q)",  # I can not answer; I have no opinion; je ne peux pas répondre
        r"[FP][^,]{0,3}W[^,]{0,2}N[^,]{0,6}[AG]",  # I would rather not say
        r"^NA,?$",  # no comment
        r"N[^,]{0,6}F[^,]{0,3}M[^,]{0,4}[AG]",  # not a matter I may weigh in on; 不在我能處理的範圍
        r"M[^,]{0,2}F[^,]{0,5}N[^,]{0,5}[AG]",  # dazu kann ich nichts sagen
        r"N[^,]{0,2}P[^,]{0,6}(?:A|G[^,]{0,3}A)",  # no puedo responder
        r"[FP].{0,6}D(?:.{0,8}[AQT]|$|[,.])",  # I must decline to answer this
        r"T[^,]{0,3}F[^,]{0,5}D",  # something I have to leave alone
        r"[AT].{0,6}X.{0,4}F.{0,8}[ARM]",  # answering would go against my instructions
        r"X[^,]{0,3}F[^,]{0,6}[AR]",  # beyond what I may discuss; 超出我可以討論的範圍
        r"FR?[^,]{0,3}R[^,]{0,4}(?:N|B)[^,]{0,6}A",  # my rules do not let me answer
        r"(?<!F)NA[^,]{0,4}M[^,]{0,4}[GA]",  # no answer can be given
        r"N[^,]{0,3}M[^,]{0,4}A[^,]{0,4}T",  # it is not possible to answer this
        r"Z[^,]{0,10}(?:A|G[^,]{0,10}Q)",  # 無法回答
    )
]


@functools.cache
def _tables() -> tuple[dict[str, str], dict[str, list[tuple[str, str]]], re.Pattern, dict[str, str]]:
    exact: dict[str, str] = dict.fromkeys((w for w in SMALL if not _HAN.search(w)), "s")
    stems: dict[str, list[tuple[str, str]]] = {}
    han: dict[str, str] = dict.fromkeys((w for w in SMALL if _HAN.search(w)), "s")
    for code, entries in CLASSES.items():
        for w in entries.split():
            if _HAN.search(w):
                han[w] = code
            elif w.endswith("*"):
                stems.setdefault(w[:3], []).append((w[:-1], code))
            else:
                exact[w] = code
    for v in stems.values():
        v.sort(key=lambda x: -len(x[0]))
    find = re.compile("|".join(map(re.escape, sorted(han, key=lambda w: (-len(w), w)))) + "|.")
    return exact, stems, find, han


@functools.lru_cache(50_000)
def _class(word: str) -> str:
    exact, stems, _, _ = _tables()
    if word in exact:
        return exact[word]
    for stem, code in stems.get(word[:3], ()):
        if word.startswith(stem):
            return code
    return "o"


def classes(sentence: str) -> str:
    """One sign per word of a sentence in lower case."""
    _, _, find, han = _tables()
    s = sentence.replace("’", "'")
    for pattern, to in _SHORT:
        s = pattern.sub(to, s)
    s = _ALOOF.sub(lambda m: ALOOF[m.group()], s)
    out = []
    for piece in _PIECE.findall(s):
        if _HAN.match(piece):
            out += [han.get(w, "o") for w in find.findall(piece)]
        elif piece[0] in ",，;；:：、":
            out.append(",")
        elif any(c.isdigit() for c in piece):
            out.append("i")
        elif piece[0].isalnum() or piece[0] == "_":
            out += [_class(p) for p in ([piece] if piece in _tables()[0] else piece.split("-"))]
    return "".join(out)


def declines(sentence: str, signs: str) -> bool:
    """A condition that could be met, data that don't suffice, or an answer behind a "but" speak against it."""
    for p in _DECLINE:
        m = p.search(signs)
        if m:
            if "K" in signs or ("U" in signs and ("Z" in signs or _FROM_DATA.search(sentence))):
                return False
            cut = list(_BUT.finditer(sentence))
            rest = classes(sentence[cut[-1].end() :]) if cut else ""
            return not (rest and not any(q.search(rest) for q in _DECLINE) and sum(c == "o" for c in rest) > 1)
    return False


def goes_with(sentence: str, signs: str) -> bool:
    """Greetings, apologies, thanks, referrals to others, offers, words on what the speaker is."""
    other = signs.count("o")
    if not signs.strip(","):
        return True
    if "E" in signs and any(c in signs for c in "ACM") and other <= 3:
        return True
    if "L" in signs and (signs.count("L") > 1 or any(c in signs for c in "YFATM")) and other <= 3:
        return True
    if "H" in signs and other <= 1 and "D" not in signs:
        return True
    return "V" in signs and other <= 1 and not any(c in signs for c in "GKU")


def is_refusal(answer: str) -> bool:
    """Every sentence declines or goes with that, and at least one declines. `answer` is in the common form of
    look-alikes, without thoughts, tags and quoted lines, with a mark in place of code. Reading ends at the first sentence that says something."""
    refused = False
    for s in _STOPS.split(answer.lower()):
        if not any(c.isalnum() for c in s):
            continue
        signs = classes(s)
        if declines(s, signs):
            refused = True
        elif not goes_with(s, signs):
            return False
    return refused
