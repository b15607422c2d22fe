"""Fixed values of the text jobs: stop words and keyword dictionaries, in their given order.

Regex categories beyond these are passed in as a rule table (category, pattern); see ``read_rules``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

STOP_WORDS = [
    "것", "수", "때", "곳", "등", "점",
    "이", "그", "저", "의", "가", "을", "를", "에", "와", "과", "도", "로", "으로",
    "은", "는", "이다", "있다", "하다", "되다", "같다",
    "정말", "너무", "진짜", "완전", "엄청", "되게", "아주", "좀", "막", "그냥",
    "아", "어", "오", "음", "흠",
    "거", "걸", "게", "네", "요", "죠", "뭐", "더", "별로", "번", "개",
    "듯", "듯하다", "다", "든", "말", "및", "분", "씩", "안", "약", "어디",
    "여기", "오늘", "요즘", "월", "위", "이번", "일", "전", "제", "중",
    "즈음", "지", "쪽", "채", "체", "후",
    "께", "데", "뿐", "잘", "캐", "테", "편", "히",
]

# exact keywords per category
KEYWORDS = {
    "가성비": ["가성비", "싸다", "저렴", "가격", "할인", "세일", "저가", "착하다"],
    "품질": ["품질", "효과", "좋다", "만족", "훌륭", "퀄리티", "우수", "괜찮다", "최고", "완벽", "추천"],
    "심미": ["디자인", "패키지", "용기", "예쁘다", "발색", "색감", "색상"],
    "편의": ["편하다", "간편", "사용감", "흡수", "발림성", "쉽다", "빠르다", "편리"],
    "물류": ["배송", "재고", "품절", "매진", "한정", "입고", "택배"],
    "품질불만": ["트러블", "자극", "여드름", "별로", "따갑다", "안맞다", "부작용"],
    "듀프": ["듀프", "대체", "비슷", "똑같", "흡사", "대신", "유사"],
    "브랜드": ["브랜드", "명품", "고가", "설화수", "라메르", "랑콤", "에스티로더", "올리브영", "올영"],
}

# regular expressions per category, with the commas missing from the source list put right
PATTERNS = {
    "가성비": [
        "가성비", "싸[다고게요]", "저렴[하한]?", "가격", "저가", "착[하한]", "가격대", "합리", "경제", "부담[없안적]",
        "비싸[다고]?", "천원", "가격대비", r"\d+원", "행사", "할인",
    ],
    "품질[긍정]": [
        r"품질\s?[이가]?\s?(?:좋|괜찮|최고|우수)", r"효과\s?[가]?\s?(?:좋|괜찮|최고|있[다어요네])", r"(?<!안\s)(?<!안\s)좋[다아고은아요네해]",
        "(?<!불)만족[스럽하해해요]", "훌륭[하한해해요]", r"퀄리티\s?[가]?\s?(?:좋|최고|우수)", "우수[하한해해요]", "괜찮[다아고게네요아]", "최고",
        "완벽[하한해해요]", "추천[해하해요]", "대박", "신기[하한해해요]", "놀랍[다고게게요]", r"기대\s?이상|기대보다\s?좋", r"성능\s?[이가]?\s?(?:좋|괜찮|최고)",
        "쓸만[하한해해요]", r"생각보다\s?좋", "가심비", r"다이소\s?최고|다이소만", "인생템", "정착[했해해요]", "재구매[할해해요]",
        r"광채\s?[가]?\s?좋|광채\s?나[요네]", r"탄력\s?[이]?\s?좋|탄력\s?있[다어요네]", r"보습[력]?\s?(?:좋|최고)",
        r"진정[효과]?\s?좋|진정\s?[이]?\s?[되돼되요]",
    ],
    "품질[부정]": [
        "트러블", "자극", "여드름", "뒤집", "알[레러]지", "알레르기", r"별로(?!\s?(?:안|인데\s?(?:좋|괜찮)))",
        "따[갑끔]", "쓰리[다고]", r"안\s?맞|맞지\s?않", "부작용", r"피부[에]?\s?안\s?좋|피부\s?트러블",
        "가렵", "주의", "발진", "뾰루지", "염증", r"불편[하해](?!\s?지\s?(?:않|는\s?않))", r"심[하한해](?!\s?지\s?않)",
        r"돈[이]?\s?아깝", r"재구매[는]?\s?안|재구매\s?없", "최악", "실망",
        r"무겁[다고](?!\s?지\s?않)", r"무거워(?!\s?하지\s?않)", "아쉬[워움]",
    ],
    "심미[긍정]": [
        r"디자인[이]?\s?(?:좋|예쁘|멋지|깔끔|세련)", r"패키지[가]?\s?(?:좋|예쁘|깔끔|고급)", r"용기[가]?\s?(?:예쁘|좋)", r"(?<!안\s)예쁘[다고게네요해]",
        r"(?<!안\s)예뻐[요서며]", r"(?<!안\s)이쁘[다고게네요해]", r"(?<!안\s)이뻐[요서며]", r"발색[이]?\s?(?:좋|예쁘|최고)",
        r"색감[이]?\s?(?:좋|예쁘)", r"색상[이]?\s?(?:예쁘|좋)|색\s?예쁘", r"색깔[이]?\s?(?:예쁘|좋)", r"외관[이]?\s?(?:좋|예쁘|깔끔)",
        r"모양[이]?\s?(?:예쁘|좋)", r"케이스[가]?\s?(?:예쁘|좋)", r"포장[이]?\s?(?:좋|예쁘|깔끔)", "귀엽[다고게네요해]|귀여워[요서]",
        "세련[되된됐돼]|세련미", "깔끔[하한해해요]", "심플[하한해해요]", r"고급[스럽져스러워]|고급미|고급\s?느낌", "럭셔리", "멋지[다고게네요해]|멋져[요서]",
        "영롱[하한해해요]", r"무드[가]?\s?좋", "감성[적]", r"취향\s?저격",
    ],
    "심미[부정]": [
        r"디자인[이]?\s?별로|디자인\s?안\s?좋", r"패키지[가]?\s?별로|패키지\s?안\s?좋", r"안\s?예쁘", r"안\s?이쁘", r"못\s?생겼", "촌스러워요",
        r"색상[이]\s?별로|색[이]\s?별로", r"색깔[이]\s?별로", r"저렴해\s?보[여이]|저렴하게\s?보[여이]", r"싸구려\s?같", r"품질\s?떨어져\s?보[여이]",
        "조악", r"택배\s?상자.*허술|포장.*허술", r"포장[이]?\s?별로", r"용기[가]?\s?별로", r"케이스[가]?\s?별로", r"발색[이]?\s?안\s?좋|발색\s?별로",
        "아쉬[워움]", r"외관[이]?\s?별로", r"보기\s?안\s?좋", "피부.*지저분|얼굴.*지저분",
    ],
    "편의[긍정]": [
        r"편[하한해해요](?!\s?지\s?않)", r"간편[하한해해요](?!\s?지\s?않)", r"사용감\s?[이가]?\s?(?:좋|괜찮)",
        r"흡수\s?[가]?\s?(?:좋|빠르)|잘\s?흡수|흡수력\s?(?:좋|괜찮)", r"발림성?\s?[이가]?\s?(?:좋|부드럽)|잘\s?발[라려]",
        "쉽[다고게요네](?!.*(?:안|않|없|못))", "빠르[다고게요네]", "(?<!불)편리[하한해해요]", "손쉽[다게요네]", "부드럽[다고게요네]|부드러워[요서]",
        "순[하한해해요]", "가볍[다고게요네]|가벼워[요서]", "촉촉[하한해해요]|촉촉해[요서]", r"여행[용]?\s?(?:좋|편)|휴대[하기]?\s?(?:좋|편)",
        r"텍스처\s?[가]?\s?좋", "발리[다고]", r"밀착\s?[이]?\s?좋|밀착력\s?좋", "산뜻[하한해해요]", r"데일리[로]?\s?좋",
    ],
    "물류[긍정]": [
        r"배송\s?빠르[다고게요]", r"빠른\s?배송", "칼배송", r"재고\s?있[다어었]", r"품절\s?안", r"구하기\s?쉽[다더게]", r"매장[에]?\s?있[었다어]",
        r"오프라인[에]?\s?있[었다어]", r"입고\s?빠르[다더게요]", r"빠른\s?입고", r"재입고\s?빨[랐]", r"구매\s?쉽[다더]", r"사기\s?쉽[다더]",
        r"찾기\s?쉽[다더]", r"바로\s?배송", r"당일\s?배송", r"익일\s?배송", r"택배\s?빠르[다더게요]", r"빠른\s?택배", r"재고\s?많[았다]",
        r"예약\s?가능", r"주문\s?가능",
    ],
    "편의[부정]": [
        r"(?<!안\s)불편[하해함](?!\s?지\s?(?:는|도)?\s?않)", r"사용(?:하기)?\s?(?:어렵[다고게]|어려[워요운])(?!\s?지\s?않)", r"쓰기\s?불편",
        r"발림성?\s?[이]?\s?(?:안\s?좋|별로)|잘\s?안\s?발[라려]", r"흡수\s?[가]?\s?(?:안\s?[되돼]|별로)",
        r"무겁[다고게]|무거워[요서](?!\s?하지\s?않)", r"너무\s?끈적|매우\s?끈적|너무\s?번들|매우\s?번들", r"뻑뻑(?:하[다고게]|해[요서])(?!\s?지\s?않)",
        r"피부.*(?:너무\s?건조|매우\s?건조)|제품.*(?:너무\s?건조|매우\s?건조)|건조[해하].*(?:불편|안\s?좋)", "당기[는다고]", "땅기[는다고]",
        r"사용감\s?[이가]?\s?(?:별로|안\s?좋)", r"텍스처\s?[가]?\s?(?:별로|안\s?좋)", r"밀착\s?[이]?\s?(?:안\s?[되돼]|별로)",
        r"여행[용]?\s?불편|휴대[하기]?\s?불편", r"부드럽지\s?않", r"딱딱(?:하[다고게]|해[요서]|함)(?!\s?지\s?않)",
        r"까칠(?:하[다고게]|해[요서])(?!\s?지\s?않)", "갈라[지짐]", r"(?<!안\s)뭉[치쳐침]", "덜[어렁걱]", "아쉬[워움]",
    ],
    "물류[부정]": [
        r"배송\s?(?:느리[다고게]|느려[요서]|늦[다고게어]|안\s?와|오래\s?걸리|최악|별로)", r"재고\s?[가는]?\s?없", "품절", "매진",
        r"입고\s?(?:늦[다고게어]|안\s?[되돼]|오래\s?걸리|느리[다고]|느려[요서])",
        r"택배\s?(?:느리[다고게]|느려[요서]|늦[다고게어]|안\s?와|오래\s?걸리|최악|별로)",
        r"예약\s?(?:안\s?[되돼]|불가|막혔|어렵[다고게]|어려[워요운])",
        r"구하기\s?(?:어렵[다고게]|어려[워요운]|힘들[다고게어요운])",
        r"찾기\s?(?:어렵[다고게]|어려[워요운]|힘들[다고게어요운])",
        r"매장[에서]?\s?없", r"상품\s?[이]?\s?없", "아쉬[워움]", r"온라인\s?(?:품절|재고\s?없)", r"오프라인\s?(?:품절|재고\s?없)",
    ],
    "희소성": [
        "품절", r"재고[가는]?\s?없|재고\s?없", "매진", r"구하기\s?어렵|구하기\s?힘들", r"구매[를]?\s?못", r"살\s?수\s?없|사기\s?어렵",
        r"없어[서]?\s?아쉽", r"제품[이]?\s?없", r"상품[이]?\s?없", "한정", r"품절\s?대란", "재입고", r"입고\s?언제",
        r"매장[에서]?\s?없|매장\s?없", r"오프라인[에서]?\s?없", r"구경\s?할\s?수\s?없", r"찾기\s?어렵|찾을\s?수\s?없",
        "웨이팅", "오픈런", "귀한",
    ],
    "듀프": [
        "듀프", "대체재", "비슷[하한해]", "똑같[다아]", "흡사", "닮[았다아]", "유사[하한]", r"차이[가]?\s?없", "저렴이",
        r"비싼\s?거\s?필요\s?없|비싼\s?제품\s?필요\s?없", "가성비템", "짭", "카피", r"[가-힣]+\s?대신\s?[써쓰사용]",
        r"비교[했하면]\s?[때도]", r"[비슷똑]\s?같[은다]",
    ],
    "로드샵브랜드": [
        "올리브영", "올영", r"무신사\s?뷰티", r"컬리\s?뷰티", "클리오", "롬앤", "페리페라", "이니스프리", "에뛰드", "미샤", "시코르", "세포라", "로드샵",
        "백화점", "면세점", r"카카오\s?선물", "홈쇼핑", "공홈", "직구", r"해외\s?직구", "닥터지", "달바", "맥", "MAC", "나스", "헤라", "어퓨",
        "A'pieu", "토니모리", "홀리카", "더페이스샵", "스킨푸드", "라네즈", "아이오페", "에이프릴스킨", "라운드랩", "코스알엑스", "비디비치", "토르", "독도",
        "더마토리", "피지오겔", r"닥터[^\s]{0,2}(?:[가-힣]|$)", "아누아", "바이오더마", "토리든", "3ce", "제로이드", "이지듀", "에스트라",
    ],
    "브랜드개념": ["브랜드", "명품", "고가", "럭셔리", "저가", "가성비템"],
    "고가브랜드": [
        "설화수", r"라\s?메르", "랑콤", r"에스티\s?로더|(?<![가-힣])에스티(?![가-힣로])", "시세이도", "크리니크", "클라랑스", "키엘", "디올",
        "샤넬", r"톰\s?포드", "겔랑", r"조\s?말론", "이솝", r"라\s?프레리", "시슬리", r"끌레드뽀\s?보떼", r"헬레나\s?루빈스타인",
        r"입생\s?로랑|생로랑|(?<![가-힣])입생(?![가-힣로])|YSL", "지방시", r"아르마니\s?뷰티", r"바비\s?브라운",
        "딥티크", "바이레도", r"메종\s?마르지엘라", r"르\s?라보", r"산타마리아\s?노벨라", "크리드", "킬리안", r"프레데릭\s?말",
    ],
    "피부타입": ["건성", "지성", "복합성", "민감성", "수부지", "속건조", "홍조", "좁쌀"],
}

POSITIVE_SUFFIX, NEGATIVE_SUFFIX = "[긍정]", "[부정]"

# Where the source list lacks a comma, so that its literal reading is one pattern out of two
MISSING_COMMAS = [("알레르기", r"별로(?!\s?(?:안|인데\s?(?:좋|괜찮)))"), ("아쉬[워움]", r"외관[이]?\s?별로"), ("아쉬[워움]", r"온라인\s?(?:품절|재고\s?없)")]


def compat_patterns(patterns: dict[str, list[str]] = PATTERNS) -> dict[str, list[str]]:
    """The categories as the source list literally reads, with neighbours that lack a comma run together."""
    out = {}
    for category, rules in patterns.items():
        joined: list[str] = []
        for rule in rules:
            if joined and (joined[-1], rule) in MISSING_COMMAS:
                joined[-1] += rule
            else:
                joined.append(rule)
        out[category] = joined
    return out


def read_rules(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A rule table (category, pattern, position) as a dictionary; rule tables are hand-written and small."""
    rows = spark.read.schema("category string, pattern string, position int").option("header", True).csv(path)
    rules: dict[str, list[str]] = {}
    for r in rows.orderBy("category", "position").collect():
        rules.setdefault(r["category"], []).append(r["pattern"])
    return rules


def rule_frame(spark: SparkSession, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(c, w) for c, words in rules.items() for w in words], "category string, keyword string")
