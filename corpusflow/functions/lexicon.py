"""Word lists of the text functions and of the query router."""

from __future__ import annotations

# These lists decide results and must stay as they are.

#: Function words that an index of a text in that language leaves out.
STOPWORDS: dict[str, list[str]] = {
    "pt": "a o os as um uma de da do das dos e ou em no na nos nas para por com que se nao não".split(),
    "en": "the and or of to in on for is are was were be as at by an this that it from with".split(),
    "es": "el la los las un una unos unas del al en para por con que se no y o pero".split(),
    "fr": "le la les un une des du de dans pour par avec que qui ne pas et ou sur ce cette".split(),
    "de": "der die das den dem des ein eine einer einem einen und oder in im für mit von zu ist sind nicht auf".split(),
    "it": "il la lo i gli le un uno una di del della in nel nella per con che non e ed sono".split(),
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только".split(),
    "zh": "的 了 和 是 就 都 而 及 與 着".split(),
    "ja": "の に は を た が で て と し れ さ".split(),
    "ko": "이 그 저 것 수 등 들 및 에 와 과".split(),
}
#: Russian words that only keywords leave out.
KEYWORD_ONLY = "ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был до вас там потом себя для".split()

#: Words that tell a language, in the order in which ties are decided.
INDICATORS: dict[str, list[str]] = {
    "pt": "de da do das dos em no na nos nas para por com que se nao não um uma os as ou como mais mas ao aos este esta esse essa isso isto pelo pela sobre".split(),
    "en": "the and or of to in on for is are was were be been as at by an this that it from with which there have has".split(),
    "es": "el la los las un una unos unas del al en para por con que como pero este esta estos estas sobre entre también tambien".split(),
    "fr": "le la les un une des du de dans pour par avec sur est sont cette ce ces qui que mais aussi".split(),
    "de": "der die das den dem des ein eine einer einem einen und oder in im für mit von zu ist sind nicht auf auch".split(),
    "it": "il la lo i gli le un uno una del della dei degli delle in nel nella per con che sono questo questa anche".split(),
}

#: Phrases and words that ask for an overview, a comparison, or a place in the text; words that carry no content there.
OVERVIEW_PHRASES = [
    "tema principal", "visão geral", "visao geral", "ideia central", "principais tópicos", "principais topicos",
    "main theme", "central idea", "key topics", "main points", "overview of", "executive summary",
    "visión general", "vision general", "idea central", "tema central", "temas clave", "puntos principales",
    "thème principal", "theme principal", "vue d'ensemble", "idée centrale", "idee centrale", "points clés", "points cles",
    "hauptthema", "überblick", "ueberblick", "zentrale idee", "hauptpunkte", "kernaussage",
    "tema principale", "panoramica", "punti principali", "argomento principale",
    "главная тема", "обзор", "центральная идея", "основные темы", "ключевые моменты", "краткое содержание",
    "主要议题", "主要主题", "核心思想", "中心思想", "概览", "全局概览", "总结概述", "要点概括", "全文总结",
    "主なテーマ", "中心的な考え", "全体の概要", "主なトピック", "全体のまとめ",
    "주요 주제", "중심 생각", "전체 개요", "주요 요점", "핵심 내용", "전체 요약",
]
OVERVIEW_WORDS = [
    "resumo", "resuma", "summarize", "summary", "overview", "synopsis", "resumen", "resume", "resumir", "résumé", "résumer", "resumer", "aperçu", "apercu",
    "zusammenfassung", "abstrakt", "riassunto", "riassumere", "резюме", "обобщение", "обобщить", "конспект", "总结", "概述", "概括", "综述", "要約", "まとめ", "概略", "요약", "개요", "줄거리",
]
COMPARE_PHRASES = [
    "em comum", "diferenças", "diferencas", "comparar", "in common", "differences", "compare the", "en común", "en comun", "diferencias",
    "en commun", "différences", "gemeinsam", "unterschiede", "im vergleich", "in comune", "differenze",
    "в общем", "различия", "разница", "сравнить", "共同点", "相同点", "区别", "不同点", "对比", "共通点", "違い", "比較", "対比", "공통점", "차이점", "비교",
]
COMPARE_WORDS = ["compare", "comparar", "vergleichen", "confrontare", "сравнить"]
LOCAL_PHRASES = [
    "neste parágrafo", "neste capitulo", "neste capítulo", "nessa seção", "nessa secao", "contexto imediato", "trecho sobre", "passagem sobre", "ao redor de",
    "in this paragraph", "in this section", "nearby context", "surrounding text", "in this chapter", "local context", "passage about",
]
FILLER = [
    "deste", "desta", "livro", "texto", "artigo", "documento", "this", "that", "book", "text", "the", "article", "document", "este", "esta", "articulo",
    "ce", "cet", "cette", "texte", "dieses", "dieser", "buch", "questo", "questa", "testo", "этот", "эта", "это", "книга", "текст", "статья", "документ",
]

#: Put before a query that an encoder reads.
QUERY_PROMPT = "Represent this sentence for searching relevant passages: "

# End of the fixed values.

#: Left out of keywords, whatever the language: every list above together.
KEYWORD_STOPWORDS: list[str] = list(dict.fromkeys([w for words in STOPWORDS.values() for w in words] + KEYWORD_ONLY))

# Words that are no entities, and the parts of an identifier.
ENTITY_STOP_WORDS = (
    "def", "class", "return", "import", "from", "self", "none", "true", "false",
    "and", "or", "not", "for", "while", "with", "as", "if", "elif", "else",
    "try", "except", "finally", "pass", "lambda", "yield", "raise", "in", "is",
)
ENTITY_PARTS = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\b)|[0-9]+"
