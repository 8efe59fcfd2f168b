"""Sentences that the clause tagger learns from, put together from parts: refusals, reports of refusals, and plain narrative.

There are no labels in the data, so these stand for what a tag means. They cover words and endings, not whole phrases: the field
learns from the characters of clauses, and then from the given responses themselves.
"""

from __future__ import annotations

import random

# Parts of Japanese refusals.
OPENINGS = ("申し訳ありませんが、", "申し訳ございません。", "すみませんが、", "すみません。", "ごめんなさい。", "ごめんなさい、", "恐縮ですが、", "恐れ入りますが、", "残念ですが、", "残念ながら、", "あいにく、", "あいにくですが、", "悪いのですが、", "失礼ですが、", "お許しください。", "大変恐縮ですが、", "せっかくですが、")
TOPICS = (
    "訳は", "訳を", "訳文は", "訳文を", "翻訳は", "翻訳を", "翻訳することは", "和訳は", "和訳を", "日本語訳は", "日本語訳を", "この訳は", "この文は", "この文を", "この文の訳は", "この文章は", "この一文は", "この発話は", "この表現は", "原文は", "原文を", "回答は", "回答を",
    "お答えは", "答えは", "返答は", "ご質問には", "ご依頼には", "ご要望には", "その質問には", "この依頼には", "意味は", "この語の意味は", "内容は", "対訳は", "日本語には", "この言語は", "この方言は", "これは", "私には", "今回は", "",
)
#: What is wrong, how, and the joint to what follows.
REASON_NOUNS = ("意味", "文脈", "情報", "根拠", "資料", "辞書", "単語", "語形", "表記", "原文", "内容", "文法", "注", "用例", "知識", "記録", "言語", "方言", "発音", "形", "前後", "手がかり", "判断材料", "訓練データ", "この言葉", "文の一部", "固有名詞", "語の区切り", "例文", "出典")
REASON_STATES = ("分からない", "足りない", "ない", "見つからない", "不明な", "読めない", "確認できない", "一致しない", "曖昧な", "知られていない", "定まらない", "特定できない", "含まれていない", "載っていない", "不十分な", "未知な", "対応していない", "判断できない", "得られない", "手元にない", "欠けている", "不適切な", "短すぎる", "誤っている", "合わない", "専門外な")
REASON_JOINTS = ("ので、", "ため、", "ことから、", "以上、", "場合は、", "ものについては、", "と思われるため、", "状態では、")
REASON_WHOLES = ("規則により、", "決まりにより、", "方針上、", "安全上の理由から、", "人工知能なので、", "AIですので、", "私は言語モデルですので、", "言語モデルなので、", "私は機械なので、", "機械なので、", "情報が足りず、", "意味が取れず、", "自信がなく、", "根拠を欠き、", "「Q」とありますが、", "「Q」と書かれていますが、", "「Q」については、")
#: What isn't done, by noun or by verb, and that it isn't.
DEEDS = ("訳", "翻訳", "和訳", "訳出", "回答", "お答え", "返答", "提供", "ご提示", "対応", "判断", "理解", "説明", "推測", "作成", "記載", "解釈", "お手伝い", "ご案内", "出力", "解読", "")
NOT_DONE = (
    "できません", "できかねます", "出来ません", "いたしません", "いたしかねます", "しかねます", "は控えます", "を控えさせていただきます", "は差し控えます", "を差し控えたく存じます", "は難しいです", "は困難です", "は不可能です", "は無理です", "は遠慮いたします", "を辞退します", "は見送ります", "を見送らせていただきます", "を省略します", "は避けます", "を見合わせます", "は保留します", "は保留といたします",
    "を保留にさせていただきます", "は行いません", "しないでおきます", "できそうにありません", "できないと思います", "ができません", "はできませんでした", "することができません", "することはできかねます", "することは不可能です", "できない状況です", "の対象外です", "は致しません", "はお断りします", "をお断りいたします", "はご容赦ください", "はご勘弁ください", "不能です", "はやめておきます",
)
VERBS = ("訳せ", "訳しかね", "読め", "読み取れ", "書け", "答えられ", "お答えでき", "応じられ", "応じかね", "示せ", "お示しでき", "出せ", "直せ", "表せ", "分かり", "分かりかね", "扱え", "引き受けられ", "承れ", "お役に立て", "お力になれ", "見つかり", "用意でき", "付けられ", "差し上げられ", "返せ", "伝えられ", "お受けでき", "手に負え", "判明し")
NOT = ("ません", "ません", "ません", "ませんでした", "ないのが実情です", "ない文です", "そうにありません", "ないと思います", "ず申し訳ありません")
OBJECTS = ("", "訳を", "訳文を", "意味を", "内容を", "日本語に", "うまく", "正しく", "対応する日本語が", "ご期待に", "何も", "結果を")
OTHERS = ("空欄とします", "空白のままにします", "難しいです", "難しいと思います", "困難です", "不可能です", "無理です", "お断りします", "断らせていただきます", "遠慮します", "ご遠慮します", "控えます", "控えたいと思います", "私の手には余ります", "私の力を超えています", "対象としていません", "対象外です")
TAILS = ("", "", "", "", "ご了承ください。", "悪しからずご了承ください。", "別の文をお送りください。", "詳しい情報をお知らせください。", "もう少し文脈をください。", "専門家にご確認ください。")

# Parts of refusals in other languages, in the order in which they follow one another.
FOREIGN = (
    (("", "", "Sorry, ", "I'm sorry, but ", "I am sorry. ", "Unfortunately, ", "Apologies, ", "Regrettably, ", "I apologise, but ", "I'm afraid "),
     ("I can't ", "I cannot ", "I can not ", "I won't ", "I will not ", "I'm unable to ", "I am not able to ", "I would rather not ", "I'd rather not ", "I must decline to ", "I have to decline to ", "I refuse to ", "I don't know how to ", "it is not possible to ", "it isn't possible for me to ", "we cannot ", "I'm not in a position to ", "I prefer not to ", "there is not enough context to ", "as an AI I cannot ", "as a language model, I am unable to ", "I do not feel able to ", "I don't have enough information to "),
     ("translate ", "render ", "answer ", "provide ", "give ", "help with ", "assist with ", "interpret ", "produce ", "complete ", "offer ", "understand ", "respond to ", "guess "),
     ("this.", "that.", "it.", "this sentence.", "this text.", "this passage.", "this request.", "a translation.", "a translation of this.", "the meaning.", "the text into Japanese.", "an answer.", "this line.", "what this means.", "the source text.")),
    (("", "Sorry: ", "Unfortunately "), ("no translation ", "this translation ", "a translation ", "an answer ", "this text ", "this sentence ", "the passage "), ("is not available.", "is unavailable.", "cannot be given.", "can't be provided.", "is impossible.", "will not be given.", "could not be produced.", "cannot be translated.", "is beyond me.", "is too unclear to translate.")),
    (("Es tut mir leid, ", "Leider ", "Entschuldigung, "), ("kann ich ", "darf ich ", "möchte ich "), ("diesen Satz ", "das ", "den Text ", "dies "), ("nicht übersetzen.", "nicht beantworten.", "nicht verstehen.")),
    (("Désolé, ", "Je regrette, ", "Malheureusement, "), ("je ne peux pas ", "je ne suis pas en mesure de ", "je refuse de "), ("traduire ", "répondre à ", "comprendre "), ("cette phrase.", "cela.", "ce texte.")),
    (("Lo siento, ", "Lamentablemente ", "Perdón, "), ("no puedo ", "no soy capaz de ", "prefiero no "), ("traducir ", "responder a ", "entender "), ("esta frase.", "esto.", "este texto.")),
    (("Mi dispiace, ", "Purtroppo "), ("non posso ", "non riesco a "), ("tradurre ", "capire "), ("questa frase.", "questo testo.")),
    (("Desculpe, ", "Infelizmente "), ("não posso ", "não consigo "), ("traduzir ", "entender "), ("esta frase.", "este texto.")),
    (("К сожалению, ", "Извините, "), ("я не могу ", "я не буду "), ("перевести ", "понять "), ("это предложение.", "этот текст.")),
    (("Maaf, ", "Mohon maaf, "), ("saya tidak bisa ", "saya tidak dapat "), ("menerjemahkan ", "menjawab "), ("kalimat ini.", "teks ini.")),
    (("抱歉，", "对不起，", "很遗憾，", ""), ("我无法", "我不能", "我不会", "恕我不能"), ("翻译", "回答", "理解", "提供"), ("这句话。", "这个句子。", "这段文字。", "译文。")),
    (("죄송합니다. ", "죄송하지만 ", "유감스럽게도 "), ("이 문장을 ", "이 글을 ", "이 질문에 ", "번역을 "), ("번역할 수 없습니다.", "답변할 수 없습니다.", "이해할 수 없습니다.", "제공할 수 없습니다.")),
)

# Parts of narrative.
PEOPLE = ("父", "母", "兄", "姉", "祖父", "祖母", "村長", "先生", "医者", "客", "隣の人", "若者", "娘", "息子", "友人", "町の人", "彼", "彼女", "役場", "学校", "大工", "叔父")
THINGS = ("舟", "海", "空", "雨", "道", "魚", "祭り", "村", "犬", "花", "橋", "火", "米", "歌", "畑", "星", "風", "屋根")
MATTERS = ("誘い", "申し出", "頼み", "会議", "祭り", "旅", "返事", "答え", "手紙", "相談", "縁談", "仕事", "翻訳の仕事", "訳", "詩の訳", "本の翻訳", "質問", "話", "約束", "支払い", "計画", "出発", "挨拶", "許可", "お断りの手紙", "お詫びの手紙")
DECLINED = (
    "断った", "断りました", "断られた", "お断りした", "見送った", "見送りにした", "見送りとなった", "保留にした", "保留となった", "保留になりました", "辞退した", "遠慮した", "控えた", "控えていた", "拒んだ", "書いた", "書きました", "出した", "受け取った", "待った", "忘れた", "できなかった", "できませんでした", "できない人だった", "諦めた", "やめた", "難しかった", "難しいと言った",
    "分からなかった", "無理だったそうだ", "空欄のままだった", "終わった", "聞いた", "届いた", "頼んだ", "手伝えなかった", "答えられなかった", "訳した", "読んだ", "失くした",
)
SAID = ("と言った。", "と言って、", "と言われ、", "と{}に言われ、", "と{}が言った。", "と{}は答えた。", "と{}に断られ、", "と書いた。", "と書いてあった。", "と聞いて、", "と{}から聞いた。", "と{}が話していた。", "と伝えた。", "と{}に告げて、")
QUOTING = ("という物を見て、", "という話を聞いて、", "は何かと聞かれ、", "と言って、", "と呼ばれる人が来て、", "の話で、", "のことで、", "と歌いながら、")
#: Plain sentences of other languages, by parts in their order.
TONGUES = (
    (("I", "We", "She", "He", "They", "My neighbour", "My brother", "The old man", "The boat", "Nobody", "Grandmother", "Our teacher", "Somebody"),
     (" saw", " forgot", " could not find", " did not sell", " carried", " asked about", " refused", " lost", " burned", " cannot sell", " read", " wrote", " answered", " hid", " gave me", " waited for"),
     (" the boat", " a seed", " the letter", " the answer", " the text on the wall", " the lamp", " an old song", " the children", " the basket", " my request", " salt"), (".", " yesterday.", " near the well.", " before the rain came.", " with a seed.", " and went home.")),
    (("他", "她", "我们", "老人", "孩子们", "我的邻居", "这个村子", "那位老师"), ("昨天", "没有", "从来不", "也", "已经", "在海边", ""), ("看见了", "卖", "带来了", "忘了", "买", "找到了", "写了", "比不上", "放下了"), ("船", "牛", "那封信", "旧房子", "盐", "雨伞", "鱼", "花"), ("。", "，然后回家了。", "，只是笑了笑。")),
    (("Mi hermano", "La vecina", "El niño", "Nosotros", "Mi padre", "Los pescadores"), (" no quiere", " vio", " vendió", " no encontró", " llevó", " no puede comprar", " perdió"), (" el barco", " la sal", " una carta", " la casa vieja", " los peces", " el caballo"), (".", " ayer.", " ni la cesta.", " en la playa.")),
    (("그는", "우리는", "할머니는", "아이들은", "이웃이"), (" 어제", " 아직", " 바다에서", ""), (" 배를", " 편지를", " 소금을", " 집을", " 물고기를"), (" 보았다.", " 팔지 않았다.", " 잃어버렸다.", " 찾지 못했다.", " 샀습니다.")),
    (("Der Nachbar", "Meine Schwester", "Das Kind", "Wir"), (" hat", " haben nicht"), (" den Korb", " das Boot", " einen Brief", " das Haus"), (" verkauft.", " gesehen.", " gefunden.")),
    (("Das Boot", "Der Fisch", "Die alte Frau", "Ein Hund", "Das Salz"), (" liegt", " steht", " schläft", " wohnt", " bleibt"), (" neben", " unter", " vor", " hinter"), (" dem Haus.", " der Brücke.", " dem Brunnen.")),
    (("The shell", "The oldest song", "A word like this", "That name", "The second part"), (" means", " stands for", " is called", " is about", " comes from"), (" the sea", " the boat", " a kind of fish", " the harbour"), (".", ", not the land.", " here.", " in this story.")),
    (("La voisine", "Mon frère", "Le vieux pêcheur", "Nous"), (" n'a pas vendu", " a perdu", " cherchons", " voit"), (" le bateau", " une lettre", " la maison", " du sel"), (".", " hier.", " près du puits.")),
    (("Kemarin kami", "Nenek", "Anak itu", "Dia tidak"), (" melihat", " menjual", " membawa", " menyimpan"), (" perahu", " surat", " garam", " rumah tua"), (".", " di dapur.", " di pantai.")),
    (("Сосед", "Моя сестра", "Мы", "Старик"), (" не продал", " видит", " потерял", " нашли"), (" лодку", " письмо", " соль", " старый дом"), (".", " вчера.")),
    (("Il cane", "Mia madre", "O menino", "A vizinha"), (" mangia", " non vende", " come", " perdeu"), (" il pesce", " la casa", " o barco", " uma carta"), (".",)),
)


def foreign(rng: random.Random) -> str:
    """A plain sentence in another language."""
    return "".join(map(rng.choice, TONGUES[0] if rng.random() < 0.4 else rng.choice(TONGUES)))


def _not(rng: random.Random) -> str:
    verb = rng.choice(VERBS)
    return verb + ("ます" if verb.endswith("かね") else rng.choice(NOT))


def reason(rng: random.Random, words: str = "") -> str:
    """Why something isn't done; `words` may be any."""
    if words:
        return words + rng.choice(("がない", "が足りない", "が合わない", "ができない", "と違う", "が分からない", "である")) + rng.choice(REASON_JOINTS)
    if rng.random() < 0.3:
        return rng.choice(REASON_WHOLES)
    return rng.choice(("", "", "この", "与えられた", "今回の", "まだ", "十分な")) + rng.choice(REASON_NOUNS) + rng.choice("がはもをに") + rng.choice(REASON_STATES) + rng.choice(REASON_JOINTS)


def refusal(rng: random.Random, words: str = "") -> str:
    """A refusal, at times with a reason of the given words."""
    if rng.random() < 0.25:
        return "".join(rng.choice(part) for part in rng.choice(FOREIGN[:2] if rng.random() < 0.6 else FOREIGN))
    opening = rng.choice(OPENINGS) if rng.random() < 0.6 else ""
    why = reason(rng, words if rng.random() < 0.5 else "") if rng.random() < 0.6 else ""
    end = rng.choice(("。", "。", "。", "", "。\n", "！"))
    middle = rng.choice(TOPICS) + rng.choice(("", "", "", "", "ここでは", "現時点では", "正確には", "十分に"))
    shape = rng.random()
    middle += rng.choice(DEEDS) + rng.choice(NOT_DONE) if shape < 0.45 else rng.choice(OBJECTS) + _not(rng) if shape < 0.75 else rng.choice(OTHERS)
    tail = rng.choice(TAILS) if end == "。" else ""
    return opening + why + middle + rng.choice(("", "", "", "", "ので")).replace("ので", "ので、空欄にします") + end + tail


def report(rng: random.Random) -> str:
    """Somebody else's refusal, after whose words the sentence goes on."""
    said = refusal(rng).strip().rstrip("。．.！\n")
    end = rng.choice(SAID).replace("{}", rng.choice(PEOPLE))
    return (f"「{said}」" if rng.random() < 0.5 else rng.choice((said.split("。")[-1], said.replace("、", "").replace("。", "")))) + end


def narrative(rng: random.Random, words: str = "") -> str:
    """Plain narrative in which things are declined, put off, unclear or translated."""
    if rng.random() < 0.25:
        return reason(rng, words or rng.choice(MATTERS)) + narrative(rng)
    who, what, did = rng.choice(PEOPLE), rng.choice(MATTERS), rng.choice(DECLINED)
    shape = rng.random()
    if shape < 0.42:
        return f"{who}{rng.choice('はがも')}{what}{rng.choice('をはがに')}{did}。"
    if shape < 0.65:
        return f"{rng.choice(('', '昨日', '今年の', '村の', '町の'))}{what}{rng.choice('はがも')}{did}。"
    subject = rng.choice(PEOPLE + THINGS) + rng.choice("はもが")
    if shape < 0.82:
        end = rng.choice(("小さい", "大きい", "古い", "遠い", "静か", "新しい", "重い", "高い", "元気", "白い", "寒い", "行かない", "食べない", "売らない", "歌わない", "知らない", "終わらない", "帰らない"))
        return f"{subject}{rng.choice(('', '', 'とても', '海で', '村で'))}{end}{rng.choice(('です', 'のです', 'でした', 'のだ', 'と思う'))}{rng.choice('。。！')}"
    if shape < 0.92:
        verb = rng.choice(("食べ", "飲み", "買い", "見え", "来", "行き", "帰り", "歌い", "待ち", "動き", "売り", "起き", "聞こえ", "降り", "咲き", "見つかり"))
        return f"{rng.choice(('', '', '今日は', '昨日から', '空は暗く、', '雨が強く、'))}{subject}{rng.choice(('酒を', '魚を', '海へ', '山へ', 'まだ', 'もう', '家に', '塩を', '', ''))}{verb}{rng.choice(('ません', 'ませんでした', 'ます', 'ました', 'たくない'))}。"
    return f"{subject}{rng.choice(('遅く', '早く', '忙しく', '若く', '村にい', 'そこにい', 'ここには', '難しく', 'よく', ''))}{rng.choice(('ありません', 'ない', 'なかった', 'ませんでした', 'いません', '中止です', '無理でした'))}。"
