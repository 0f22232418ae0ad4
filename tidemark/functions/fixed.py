"""Word lists, weights and lookup tables the results depend on."""

# Headline event categories and their keywords.
EVENT_KEYWORDS = {
    "earnings": ("earnings", "eps", "quarterly results", "q1", "q2", "q3", "q4", "revenue",
                 "실적", "어닝", "영업이익", "순이익", "매출"),
    "guidance": ("guidance", "outlook", "forecast", "cuts forecast", "raises forecast",
                 "가이던스", "실적전망", "전망치"),
    "ma": ("acquisition", "acquire", "acquires", "merger", "buyout", "takeover", "인수", "합병", "지분인수"),
    "analyst": ("upgrade", "downgrade", "price target", "initiates", "overweight", "underweight",
                "reiterates", "목표주가", "투자의견", "매수의견"),
    "regulatory_legal": ("lawsuit", "investigation", "antitrust", "probe", "fine", "settlement", "subpoena",
                         "소송", "조사", "제재", "과징금", "검찰"),
    "product": ("launch", "unveils", "approval", "fda", "partnership", "contract", "출시", "수주", "계약", "승인"),
    "leadership": ("ceo", "cfo", "resign", "steps down", "appoints", "대표이사", "사임", "선임"),
    "capital": ("offering", "dilution", "buyback", "repurchase", "dividend", "stock split", "spinoff",
                "유상증자", "무상증자", "자사주", "배당", "감자"),
}

# Hard catalysts.
NEGATIVE_CATALYSTS = (
    "bankrupt", "bankruptcy", "fraud", "delist", "going concern", "default", "trading halt", "downgrade",
    "downgrades", "recall", "recalls", "lawsuit", "investigation", "probe", "guidance cut", "cuts guidance",
    "profit warning", "earnings miss", "misses estimates", "slumps", "plunges",
    "상장폐지", "거래정지", "관리종목", "감자", "유상증자", "횡령", "배임", "적자전환", "급락",
)
POSITIVE_CATALYSTS = (
    "beats estimates", "tops estimates", "raises guidance", "record revenue", "upgrade", "upgrades",
    "fda approval", "wins contract", "to acquire", "acquires", "surges", "흑자전환", "신고가", "수주", "급등",
)

# Macro risk buckets, most severe first, with their weights.
MACRO_RISK_BUCKETS = (
    ("war_conflict", 2, (
        "invasion", "invades", "declares war", "war breaks out", "missile strike", "missile attack", "airstrike",
        "air strike", "nuclear test", "nuclear threat", "nuclear weapon", "strait of hormuz", "naval blockade",
        "strait blockade", "port blockade", "military strike",
        "전쟁 발발", "전면전", "침공", "공습", "핵실험", "해상 봉쇄", "해협 봉쇄", "무력 충돌")),
    ("market_crash", 2, (
        "market crash", "stocks crash", "stock market crash", "circuit breaker", "trading halt", "flash crash",
        "sovereign default", "defaults on its debt", "enters bear market",
        "증시 폭락", "코스피 폭락", "주식시장 폭락", "글로벌 증시 폭락", "서킷브레이커", "사이드카",
        "국가 부도", "국가 디폴트", "채무불이행")),
    ("emergency_central_bank", 2, (
        "emergency rate cut", "emergency rate hike", "intermeeting cut", "emergency fomc",
        "central bank emergency", "currency intervention", "긴급 금리", "긴급 금통위", "외환시장 개입")),
    ("oil_supply_shock", 1, (
        "oil prices surge", "oil price surge", "oil surges", "oil spikes", "oil soars", "crude surges",
        "crude spikes", "crude soars", "opec cuts", "opec+ cuts", "oil embargo", "oil supply disruption",
        "유가 급등", "원유 공급 차질")),
    ("tariff_sanctions", 1, (
        "new tariffs", "tariff hike", "raises tariffs", "retaliatory tariff", "trade war escalat",
        "imposes sanctions", "new sanctions", "export ban",
        "무역 전쟁", "보복 관세", "관세 인상", "추가 제재", "수출 금지")),
)

# The two-term rule for central-bank emergencies.
CENTRAL_BANK_WORDS = ("fed", "fomc", "ecb", "boj", "bok")
CENTRAL_BANK_SUBSTRINGS = ("central bank", "연준", "한은", "금통위")
EMERGENCY_PHRASES = ("emergency meeting", "emergency session", "긴급 회의", "긴급회의")

# Tokens that carry no theme.
KO_STOPWORDS = (
    "속보", "특징주", "단독", "분석", "전망", "공시", "종목", "기업", "회사", "주식", "주가", "시장", "코스피",
    "코스닥", "한국", "미국", "중국", "일본", "오늘", "어제", "내일", "이번", "지난", "최근", "기자", "보도",
    "뉴스", "발표", "참고", "관련", "이상", "이하", "이내", "이후", "이전", "원", "달러", "조원", "억원", "만원",
    "상승", "하락", "강세", "약세", "돌파", "급등", "급락", "반등", "상한가", "하한가", "신고가", "신저가",
    "매수", "매도",
)
EN_STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "by", "and", "or", "but", "with", "from", "as",
    "is", "are", "was", "were", "be", "been", "this", "that", "these", "those", "it",
)

# Macro calendar keywords and the countries they count for.
MACRO_KEYWORDS = (
    "fomc", "fed interest rate", "federal funds", "interest rate decision", "cpi", "consumer price index",
    "inflation rate", "nonfarm", "non-farm", "nfp", "unemployment rate",
)
MACRO_COUNTRIES = ("us", "united states")

# Trading and calendar days per timeframe.
TRADING_DAYS = {"1W": 5, "2W": 10, "1M": 21, "3M": 63, "6M": 126, "1Y": 252}
CALENDAR_DAYS = {"1W": 7, "2W": 14, "1M": 30, "3M": 90, "6M": 180, "1Y": 365}
