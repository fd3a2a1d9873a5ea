"""Formats of generated texts: templates, sizes and preferences, as data; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass

# The text of each format; a field stands in braces.
TEMPLATES = {
    "straight": "{title}\n\n{lead}\n\n{body}\n\n{closing}\n\n---\n출처: {sources}",
    "brief": "[속보] {title}\n\n{content}",
    "analysis": "{title}\n\n{subtitle}\n\n■ 현황\n{current_situation}\n\n■ 배경\n{background}\n\n■ 전망\n{outlook}\n\n■ 시사점\n{implications}\n\n---\n출처: {sources}",
    "explainer": "{title}\n\n[Q] {question}\n\n[A] {answer}\n\n■ 핵심 정리\n{key_points}\n\n---\n출처: {sources}",
    "card_news": "=== {title} ===\n\n{cards}\n\n---\n출처: {sources}",
    "social_post": "{hook}\n\n{main_content}\n\n{hashtags}\n\n{cta}",
    "newsletter": "{greeting}\n\n━━━━━━━━━━━━━━━━━━━━━━\n\n{sections}\n\n━━━━━━━━━━━━━━━━━━━━━━\n\n{footer}",
    "listicle": "{title}\n\n{intro}\n\n{items}\n\n{conclusion}\n\n---\n출처: {sources}",
    "qna": "{title}\n\n{intro}\n\n{qa_pairs}\n\n■ 요약\n{summary}\n\n---\n출처: {sources}",
    "timeline": "{title}\n\n[타임라인]\n\n{events}\n\n■ 현재 상황\n{current_status}\n\n---\n출처: {sources}",
    "comparison": "{title}\n\n■ {item_a_name}\n{item_a_content}\n\n■ {item_b_name}\n{item_b_content}\n\n■ 비교 분석\n{comparison_analysis}\n\n■ 결론\n{conclusion}\n\n---\n출처: {sources}",
    "feature": "{title}\n\n{subtitle}\n\n{intro}\n\n{sections}\n\n{conclusion}\n\n---\n출처: {sources}",
}


@dataclass(frozen=True)
class Spec:
    least: int
    most: int
    structure: tuple[str, ...]
    images: str
    use: str


# Characters, structure, images and use of each format; elements that any of them may have.
SPECS = {
    "straight": Spec(400, 800, ("lead", "body", "closing"), "1", "일반 뉴스"),
    "brief": Spec(50, 100, ("single_paragraph",), "0", "속보, 단신"),
    "analysis": Spec(1500, 3000, ("current", "background", "outlook", "implications"), "2-3", "심층 보도"),
    "feature": Spec(2000, 5000, ("intro", "sections", "conclusion"), "5+", "기획 시리즈"),
    "explainer": Spec(800, 1500, ("question", "answer", "context"), "1-2", "복잡한 이슈 해설"),
    "card_news": Spec(150, 500, ("cards",), "5-10", "SNS 공유용"),
    "social_post": Spec(50, 280, ("hook", "main", "cta"), "1", "트위터/인스타"),
    "newsletter": Spec(1000, 2000, ("greeting", "sections", "footer"), "thumbnails", "이메일 발송"),
    "listicle": Spec(1000, 2000, ("intro", "items", "conclusion"), "per_item", "정보 정리형"),
    "qna": Spec(500, 1500, ("intro", "qa_pairs", "summary"), "0-1", "FAQ 형식"),
}
OPTIONAL = ("image", "quote", "background")
# Reasons for a format by feature and value.
REASONS = (
    ("urgency", "breaking", ("brief", "straight"), "속보성 뉴스"), ("complexity", "complex", ("analysis", "explainer"), "복잡한 이슈 설명"), ("length", "long", ("feature",), "충분한 콘텐츠 깊이"),
)
# Formats that an urgency, a topic and a text with figures prefer; each next one of a list counts less.
URGENCY_FORMATS = {"breaking": ("brief", "straight", "social_post"), "daily": ("straight", "analysis", "card_news"), "evergreen": ("feature", "explainer", "listicle")}
TOPIC_FORMATS = {
    "정치": ("straight", "analysis", "timeline"), "경제": ("analysis", "infographic", "comparison"), "IT/과학": ("explainer", "feature", "listicle"),
    "문화/연예": ("photo_news", "card_news", "social_post"), "스포츠": ("straight", "photo_news", "brief"), "사회": ("straight", "timeline", "feature"),
    "국제": ("analysis", "explainer", "comparison"), "건강/의료": ("explainer", "qna", "listicle"),
}
FIGURE_FORMATS = ("infographic", "comparison", "listicle")
PEOPLE_FORMATS = ("feature", "qna", "straight")
# Images that each type of article keeps.
IMAGES_OF_TYPE = {"standard": 5, "visual": 8, "data": 3}
# Words of texts that are made from facts.
ACTION_VERBS = {"투자": "투자 확대", "생산": "생산 확대"}
NUMBER_CONTEXTS = {
    "주가": "주가", "시총": "시총", "시가총액": "시총", "매출": "매출", "영업이익": "영업이익", "순이익": "순이익", "점유율": "점유율", "성장률": "성장률",
    "수출": "수출", "수입": "수입", "흑자": "경상흑자",
}
PRICE_ACTIONS = ("상승", "하락", "급등", "급락", "반등")
# Constraints of prompts, by mode and for all.
MODE_CONSTRAINTS = {
    "synthesis": "여러 뉴스의 정보를 통합하여 하나의 완성된 기사로 작성 (단일 소스에만 의존하지 않기)",
    "compression": "핵심 정보만 간결하게 압축",
    "expansion": "배경과 맥락을 추가하여 상세하게 확장",
}
CONSTRAINTS = (
    "팩트만 포함, 추측이나 의견/칼럼 내용 배제", "한국어 맞춤법과 문법 준수", "제목은 원본 기사 제목을 복사하지 말고 새로 작성 (매체명, 칼럼 태그 포함 금지)",
    "원본 문장을 그대로 복사하지 말고 재작성하여 표절 방지", "본문에 출처 매체명을 인라인으로 삽입하지 않기 (예: '뉴스1', '중앙일보' 등)",
)
CITED_CONSTRAINT = "출처는 기사 맨 끝에 별도 표기"
# Outlets by domain, tiers by outlet.
DOMAIN_NAMES = {
    "news.yna.co.kr": "연합뉴스", "yna.co.kr": "연합뉴스", "news.kbs.co.kr": "KBS", "imnews.imbc.com": "MBC", "news.sbs.co.kr": "SBS", "chosun.com": "조선일보",
    "joongang.co.kr": "중앙일보", "hani.co.kr": "한겨레", "donga.com": "동아일보", "mk.co.kr": "매일경제", "hankyung.com": "한국경제", "ytn.co.kr": "YTN", "jtbc.co.kr": "JTBC",
}
FIRST_TIER = ("연합뉴스", "KBS", "MBC", "SBS", "조선일보", "중앙일보", "한겨레", "동아일보", "YTN", "JTBC", "Reuters", "AP", "Bloomberg", "BBC", "CNN")
SECOND_TIER = ("매일경제", "한국경제", "뉴시스", "뉴스1", "아시아경제", "서울신문", "경향신문", "한국일보")
KNOWN_TIERS = {
    "대한민국 정책브리핑": "whitelist", "Korea.net": "whitelist", "연합뉴스": "tier1", "yna.co.kr": "tier1", "KBS": "tier1", "KBS 뉴스": "tier1", "MBC": "tier1", "MBC 뉴스": "tier1",
    "SBS": "tier1", "SBS 뉴스": "tier1", "조선일보": "tier1", "중앙일보": "tier1", "한겨레": "tier1", "동아일보": "tier1", "BBC": "tier1", "BBC News": "tier1", "Reuters": "tier1",
    "AP News": "tier1", "The New York Times": "tier1", "The Washington Post": "tier1", "CNN": "tier1", "네이트": "tier2", "뉴스펭귄": "tier2", "매일경제": "tier2", "한국경제": "tier2",
}
# Parts of image addresses that rule an image of a page out, endings and hosts that speak for one.
WEB_IMAGE_WORDS = (
    "icon", "logo", "btn", "button", "badge", "util_", "_util", "tool-", "-tool", "bookmark", "print", "copy", "font", "_bg", "bg_", "series_", "header_", "footer_", "_info", "info_",
    "notice_", "popup_", "modal_", "banner", "ad_", "ads_", "/ad/", "/ads/", "adsense", "advert", "sponsor", "promo", "campaign", "click", "track", "sns", "share", "social", "kakao",
    "facebook", "twitter", "naver_", "google_", "thumb_s", "thumb_xs", "_s.", "_xs.", "_t.", "small_", "_small", "mini_", "_mini", "/feed/", "feed_", "_feed", "journalist", "reporter",
    "byline", "author", "related_", "_related", "recommend", "sidebar", "player", "video_", "_video", "play_", "_play", "loading", "spinner", "placeholder", "default", "pixel", "tracker",
    "spacer", "blank", "transparent", "1x1", "1px", "sprite", "emoji", "avatar", "profile", "nav_", "menu_", "comment", "reply", "like", "dislike",
)
WEB_IMAGE_HOSTS = ("imgnews", "img", "image", "photo", "cdn", "media", "pimg", "dimg")
