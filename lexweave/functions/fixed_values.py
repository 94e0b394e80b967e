"""Fixed values of the domain: rule rows, terms, synonyms, templates.

Callers may pass tables of their own instead of each of these.
"""

# Law -> laws with parallel provisions.
PARALLEL_LAWS = (
    ("소득세법", ("법인세법", "조세특례제한법")),
    ("법인세법", ("소득세법", "조세특례제한법", "부가가치세법")),
    ("소득세법 시행령", ("법인세법 시행령", "소득세법", "법인세법", "조세특례제한법 시행령")),
    ("법인세법 시행령", ("소득세법 시행령", "소득세법", "법인세법", "조세특례제한법 시행령", "부가가치세법", "부가가치세법 시행령")),
    ("부가가치세법", ("법인세법", "법인세법 시행령", "조세특례제한법")),
    ("부가가치세법 시행령", ("법인세법 시행령", "법인세법", "조세특례제한법 시행령")),
    ("조세특례제한법", ("소득세법", "법인세법", "부가가치세법")),
    ("조세특례제한법 시행령", ("소득세법 시행령", "법인세법 시행령", "부가가치세법 시행령")),
)

# Keyword -> synonyms.
KEYWORD_SYNONYMS = (
    ("손금", ("필요경비",)),
    ("손금불산입", ("필요경비불산입",)),
    ("손금산입", ("필요경비산입",)),
    ("필요경비", ("손금",)),
    ("필요경비불산입", ("손금불산입",)),
    ("필요경비산입", ("손금산입",)),
    ("업무무관비용", ("업무와관련없는비용",)),
    ("업무와관련없는비용", ("업무무관비용",)),
    ("익금", ("총수입금액",)),
    ("익금불산입", ("총수입금액불산입",)),
    ("총수입금액", ("익금",)),
    ("총수입금액불산입", ("익금불산입",)),
    ("각사업연도", ("과세기간",)),
    ("사업연도", ("과세기간",)),
    ("과세기간", ("사업연도",)),
    ("결손금", ("결손금",)),
    ("이월결손금", ("이월결손금",)),
    ("법인", ("거주자", "사업자")),
    ("내국법인", ("거주자",)),
    ("거주자", ("내국법인", "법인")),
    ("세액공제", ("세액감면",)),
    ("세액감면", ("세액공제",)),
    ("기부금", ("기부금",)),
    ("기업업무추진비", ("기업업무추진비", "접대비")),
    ("접대비", ("기업업무추진비",)),
    ("업무용승용차", ("업무용승용차",)),
    ("재해손실세액공제", ("재해손실세액공제",)),
)

# Phrase -> phrases.
PHRASE_SYNONYMS = (
    ("손금에산입하지아니한다", ("필요경비에산입하지아니한다",)),
    ("손금에산입하지아니한", ("필요경비에산입하지아니한",)),
    ("필요경비에산입하지아니한다", ("손금에산입하지아니한다",)),
    ("필요경비에산입하지아니한", ("손금에산입하지아니한",)),
    ("각사업연도", ("과세기간",)),
    ("과세기간", ("각사업연도", "사업연도")),
    ("업무와관련없는비용", ("업무무관비용",)),
    ("업무무관비용", ("업무와관련없는비용",)),
    ("접대비", ("기업업무추진비",)),
    ("기업업무추진비", ("접대비",)),
)

# Terms of parallel provisions.
CORE_TERMS = (
    "손금불산입",
    "손금산입",
    "필요경비불산입",
    "필요경비산입",
    "익금불산입",
    "총수입금액불산입",
    "결손금",
    "이월결손금",
    "기부금",
    "기업업무추진비",
    "접대비",
    "업무무관비용",
    "업무와관련없는비용",
    "업무용승용차",
    "재해손실세액공제",
)

# Wordings that two tax laws share.
TAX_PAIR_REPLACEMENTS = (
    ("필요경비에산입하지아니", "필요경비에산입하지아니"),
    ("손금에산입하지아니", "필요경비에산입하지아니"),
    ("필요경비에산입", "필요경비에산입"),
    ("손금에산입", "필요경비에산입"),
    ("필요경비불산입", "필요경비불산입"),
    ("손금불산입", "필요경비불산입"),
    ("필요경비산입", "필요경비산입"),
    ("손금산입", "필요경비산입"),
    ("필요경비", "필요경비"),
    ("손금", "필요경비"),
    ("각사업연도", "과세기간"),
    ("사업연도", "과세기간"),
    ("내국법인", "거주자"),
    ("법인", "거주자"),
    ("업무와관련없는비용", "업무무관비용"),
    ("관련비용", "관련비용"),
    ("관련비용등", "관련비용등"),
)

# Topic terms.
TOPIC_TERMS = (
    "업무용승용차",
    "필요경비불산입",
    "필요경비산입",
    "필요경비에산입하지아니",
    "필요경비에산입",
    "업무무관비용",
    "기부금",
    "기업업무추진비",
    "접대비",
    "결손금",
    "이월결손금",
    "재해손실세액공제",
    "감가상각비",
    "한도",
    "특례",
    "세액공제",
    "세액감면",
    "익금",
    "총수입금액",
)

# Fixed values: (source law, parallel law, article key, place, article, reason).
PARALLEL_RULES = (
    ("법인세법", "소득세법", "13", 0, "제45조", "법인세법 제13조의 이월결손금 공제는 소득세법 제45조 결손금 및 이월결손금 공제와 병행 검토 필요"),
    ("법인세법", "소득세법", "21", 0, "제33조제1항제12호", "법인세법 제21조의 손금불산입 항목은 소득세법 제33조 필요경비 불산입 항목과 병행 검토 필요"),
    ("법인세법", "소득세법", "23", 0, "제33조제1항제6호", "법인세법 제23조의 감가상각비 손금불산입은 소득세법 제33조제1항제6호의 감가상각비 필요경비 불산입과 병행 검토 필요"),
    ("법인세법", "소득세법", "24", 0, "제34조", "법인세법 제24조의 기부금 손금불산입은 소득세법 제34조 기부금 필요경비 불산입과 병행 검토 필요"),
    ("법인세법", "소득세법", "25", 0, "제35조", "법인세법 제25조의 기업업무추진비 손금불산입은 소득세법 제35조 기업업무추진비 필요경비 불산입과 병행 검토 필요"),
    ("법인세법", "소득세법", "27", 0, "제33조제1항제13호", "법인세법 제27조의 업무와 관련 없는 비용 손금불산입은 소득세법 제33조제1항제13호 업무무관 경비 필요경비 불산입과 병행 검토 필요"),
    ("법인세법", "소득세법", "27의2", 0, "제33조의2", "법인세법 제27조의2의 업무용승용차 관련비용 손금불산입 특례는 소득세법 제33조의2와 병행 검토 필요"),
    ("법인세법", "소득세법 시행령", "27의2", 0, "제78조의3", "법인세법 제27조의2의 업무용승용차 관련비용 손금불산입 특례 개정은 소득세법 제33조의2의 하위규정인 소득세법 시행령 제78조의3과 병행 검토 필요"),
    ("법인세법", "소득세법 시행규칙", "27의2", 0, "제42조", "법인세법 제27조의2의 업무용승용차 관련비용 손금불산입 특례 개정은 소득세법 제33조의2의 하위규정인 소득세법 시행규칙 제42조와 병행 검토 필요"),
    ("법인세법", "법인세법 시행령", "27의2", 0, "제50조의2", "법인세법 제27조의2의 업무용승용차 관련비용 손금불산입 특례는 법인세법 시행령 제50조의2 세부기준과 연쇄 검토 필요"),
    ("법인세법", "법인세법 시행규칙", "27의2", 0, "제27조의2", "법인세법 제27조의2의 업무용승용차 관련비용 손금불산입 특례는 법인세법 시행규칙 제27조의2 서식·세부사항과 연쇄 검토 필요"),
    ("법인세법", "소득세법", "58", 0, "제58조", "법인세법 제58조의 재해손실 세액공제는 소득세법 제58조 재해손실세액공제와 병행 검토 필요"),
    ("법인세법", "부가가치세법", "11", 0, "제8조", "법인세법 제11조의 납세지 변경신고는 부가가치세법 제8조의 사업자등록·변경신고와 연동 검토 필요"),
    ("법인세법", "부가가치세법", "23", 0, "제41조", "법인세법 제23조의 감가상각비 규정은 부가가치세법 제41조의 감가상각자산 공통매입세액 재계산과 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "23", 1, "제43조", "법인세법 제23조의 감가상각자산 규정은 부가가치세법 제43조의 감가상각자산 과세사업 전환 매입세액공제와 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "23", 2, "제44조", "법인세법 제23조의 감가상각자산 규정은 부가가치세법 제44조의 재고품등 매입세액 공제특례와 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "75의5", 0, "제32조", "법인세법 제75조의5의 증명서류 수취 불성실 가산세는 부가가치세법 제32조의 세금계산서 발급 규정과 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "75의5", 1, "제35조", "법인세법 제75조의5의 증명서류 수취 불성실 가산세는 부가가치세법 제35조의 수입세금계산서와 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "75의8", 0, "제54조", "법인세법 제75조의8의 계산서 등 제출 불성실 가산세는 부가가치세법 제54조의 세금계산서합계표 제출과 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "111", 0, "제8조", "법인세법 제111조의 사업자등록은 부가가치세법 제8조의 사업자등록과 연동 검토 필요"),
    ("법인세법", "부가가치세법", "116", 0, "제32조", "법인세법 제116조의 지출증명서류 수취·보관은 부가가치세법 제32조의 세금계산서 발급과 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "116", 1, "제35조", "법인세법 제116조의 지출증명서류 수취·보관은 부가가치세법 제35조의 수입세금계산서와 연쇄 검토 필요"),
    ("법인세법", "부가가치세법", "120의3", 0, "제54조", "법인세법 제120조의3의 매입처별 세금계산서합계표 제출은 부가가치세법 제54조의 세금계산서합계표 제출과 연쇄 검토 필요"),
    ("소득세법", "법인세법", "45", 0, "제13조", "소득세법 제45조의 결손금 및 이월결손금 공제는 법인세법 제13조 이월결손금 공제와 병행 검토 필요"),
    ("소득세법", "법인세법", "33", 0, "제21조", "소득세법 제33조의 필요경비 불산입 항목은 법인세법 제21조 손금불산입 항목과 병행 검토 필요"),
    ("소득세법", "법인세법", "33항1호6", 0, "제23조", "소득세법 제33조제1항제6호의 감가상각비 필요경비 불산입은 법인세법 제23조 감가상각비 손금불산입과 병행 검토 필요"),
    ("소득세법", "법인세법", "33항1호13", 0, "제27조", "소득세법 제33조제1항제13호의 업무무관 경비 필요경비 불산입은 법인세법 제27조 업무와 관련 없는 비용 손금불산입과 병행 검토 필요"),
    ("소득세법", "법인세법", "33의2", 0, "제27조의2", "소득세법 제33조의2의 업무용승용차 관련 비용 필요경비 불산입 특례는 법인세법 제27조의2와 병행 검토 필요"),
    ("소득세법", "법인세법 시행령", "33의2", 0, "제50조의2", "소득세법 제33조의2의 업무용승용차 관련 비용 필요경비 불산입 특례 개정은 법인세법 제27조의2의 하위규정인 법인세법 시행령 제50조의2와 병행 검토 필요"),
    ("소득세법", "법인세법 시행규칙", "33의2", 0, "제27조의2", "소득세법 제33조의2의 업무용승용차 관련 비용 필요경비 불산입 특례 개정은 법인세법 제27조의2의 하위규정인 법인세법 시행규칙 제27조의2와 병행 검토 필요"),
    ("소득세법", "소득세법 시행령", "33의2", 0, "제78조의3", "소득세법 제33조의2의 업무용승용차 관련 비용 필요경비 불산입 특례는 소득세법 시행령 제78조의3 세부기준과 연쇄 검토 필요"),
    ("소득세법", "소득세법 시행규칙", "33의2", 0, "제42조", "소득세법 제33조의2의 업무용승용차 관련 비용 필요경비 불산입 특례는 소득세법 시행규칙 제42조 서식·세부사항과 연쇄 검토 필요"),
    ("소득세법", "법인세법", "34", 0, "제24조", "소득세법 제34조의 기부금 필요경비 불산입은 법인세법 제24조 기부금 손금불산입과 병행 검토 필요"),
    ("소득세법", "법인세법", "35", 0, "제25조", "소득세법 제35조의 기업업무추진비 필요경비 불산입은 법인세법 제25조 기업업무추진비 손금불산입과 병행 검토 필요"),
    ("소득세법", "법인세법", "58", 0, "제58조", "소득세법 제58조의 재해손실세액공제는 법인세법 제58조 재해손실 세액공제와 병행 검토 필요"),
    ("법인세법 시행령", "부가가치세법", "22", 0, "제39조", "법인세법 시행령 제22조의 부가가치세 매입세액 손금산입은 부가가치세법 제39조의 공제하지 아니하는 매입세액과 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법", "22", 1, "제42조", "법인세법 시행령 제22조의 부가가치세 매입세액 손금산입은 부가가치세법 제42조의 의제매입세액 공제특례와 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "22", 0, "제74조", "법인세법 시행령 제22조의 매입세액 손금산입은 부가가치세법 시행령 제74조의 매입처별 세금계산서합계표 관련 매입세액 공제와 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "22", 1, "제75조", "법인세법 시행령 제22조의 매입세액 손금산입은 부가가치세법 시행령 제75조의 세금계산서 기재사항 관련 매입세액 공제와 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "24", 0, "제66조", "법인세법 시행령 제24조의 감가상각자산 범위는 부가가치세법 시행령 제66조의 감가상각자산 자가공급 등 공급가액 계산과 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "24", 1, "제83조", "법인세법 시행령 제24조의 감가상각자산 범위는 부가가치세법 시행령 제83조의 납부세액·환급세액 재계산과 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "24", 2, "제85조", "법인세법 시행령 제24조의 감가상각자산 범위는 부가가치세법 시행령 제85조의 감가상각자산 과세사업 전환 매입세액 공제특례와 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "24", 3, "제86조", "법인세법 시행령 제24조의 감가상각자산 범위는 부가가치세법 시행령 제86조의 일반과세자 전환 시 재고품등 매입세액 공제특례와 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "24", 4, "제107조", "법인세법 시행령 제24조의 감가상각자산 범위는 부가가치세법 시행령 제107조의 조기환급 대상 사업 설비와 연쇄 검토 필요"),
    ("법인세법 시행령", "부가가치세법 시행령", "19의2", 0, "제87조", "법인세법 시행령 제19조의2의 대손금 인정 사유는 부가가치세법 시행령 제87조의 대손세액 공제 범위와 연쇄 검토 필요"),
    ("부가가치세법", "법인세법", "8", 0, "제111조", "부가가치세법 제8조의 사업자등록은 법인세법 제111조의 사업자등록과 연동 검토 필요"),
    ("부가가치세법", "법인세법", "8", 1, "제11조", "부가가치세법 제8조의 변경신고는 법인세법 제11조의 납세지 변경신고와 연동 검토 필요"),
    ("부가가치세법", "법인세법", "32", 0, "제116조", "부가가치세법 제32조의 세금계산서 발급은 법인세법 제116조의 지출증명서류 수취·보관과 연쇄 검토 필요"),
    ("부가가치세법", "법인세법", "35", 0, "제116조", "부가가치세법 제35조의 수입세금계산서는 법인세법 제116조의 지출증명서류 수취·보관과 연쇄 검토 필요"),
    ("부가가치세법", "법인세법", "41", 0, "제23조", "부가가치세법 제41조의 감가상각자산 공통매입세액 재계산은 법인세법 제23조의 감가상각비 규정과 연쇄 검토 필요"),
    ("부가가치세법", "법인세법", "43", 0, "제23조", "부가가치세법 제43조의 감가상각자산 과세사업 전환 매입세액공제는 법인세법 제23조의 감가상각비 규정과 연쇄 검토 필요"),
    ("부가가치세법", "법인세법", "54", 0, "제120조의3", "부가가치세법 제54조의 세금계산서합계표 제출은 법인세법 제120조의3의 매입처별 세금계산서합계표 제출과 연쇄 검토 필요"),
    ("부가가치세법 시행령", "법인세법 시행령", "83", 0, "제24조", "부가가치세법 시행령 제83조의 감가상각자산 관련 재계산은 법인세법 시행령 제24조의 감가상각자산 범위와 연쇄 검토 필요"),
    ("부가가치세법 시행령", "법인세법 시행령", "87", 0, "제19조의2", "부가가치세법 시행령 제87조의 대손세액 공제 범위는 법인세법 시행령 제19조의2의 대손금 인정 사유와 연쇄 검토 필요"),
)

# Names of tax laws.
TAX_LAW_KEYWORDS = (
    "소득세법",
    "법인세법",
    "부가가치세법",
    "조세특례제한법",
    "상속세",
    "증여세",
    "국제조세",
    "지방세",
    "개별소비세",
    "교통에너지환경세",
    "취득세",
    "등록세",
)

# Fixed values: (keyword, law, reason).
TITLE_TOPIC_RULES = (
    ("법인세", "법인세법", "조특법 제목·본문에 법인세 키워드"),
    ("소득세", "소득세법", "조특법 제목·본문에 소득세 키워드"),
    ("부가가치세", "부가가치세법", "조특법 제목·본문에 부가가치세 키워드"),
    ("감면", "법인세법", "세액감면·감면 특례는 법인세 과세구조와 연동 검토"),
    ("공제", "법인세법", "세액공제 특례는 법인세·소득세 공제 조문과 연동 검토"),
    ("투자", "조세특례제한법", "투자세액공제 등 조특법 내부 연계"),
    ("연구", "조세특례제한법", "연구·인력개발비 세액공제 특례"),
    ("이월", "법인세법", "이월결손금·결손금 관련 특례"),
    ("감가상각", "법인세법", "감가상각 관련 특례"),
    ("취득", "법인세법", "자산취득·양도 관련 특례"),
)

# Fixed values: (law, article, paragraph, item, place, related law, article, reason, type).
RELATED_HINTS = (
    ("소득세법", "129", "1", "3", 0, "소득세법", "제127조제1항제3호", "원천징수대상 사업소득(제129조제1항제3호 세율 적용 소득)에 대한 원천징수 의무", "rate_application"),
    ("소득세법", "129", "1", "3", 1, "소득세법", "제144조제1항", "원천징수세율을 적용하여 원천징수세액을 산출하는 규정", "calculation_rule"),
    ("소득세법", "129", "1", "3", 2, "소득세법", "제73조제1항제4호", "제127조 원천징수 사업소득과 연동되는 종합과세 적용 판정", "definition_scope"),
    ("소득세법", "129", "1", "3", 3, "소득세법 시행령", "제137조제1항", "제73조제1항제4호 사업소득 범위(원천징수·연말정산 연동)", "law_to_decree"),
    ("소득세법", "129", "1", "3", 4, "소득세법 시행령", "제184조", "제127조제1항제3호 사업소득 정의(원천징수 세율 적용 소득과 동일 축)", "law_to_decree"),
)

# Relation type -> label.
RELATION_LABELS = (
    ("rate_application", "세율 적용 축"),
    ("definition_scope", "정의→대상"),
    ("calculation_rule", "산출 규정"),
    ("law_to_decree", "법률 위임→시행령"),
    ("parallel_tax_law", "병행 세법"),
)

# Relation type -> keywords, in order.
RELATION_KEYWORDS = (
    ("rate_application", ("세율", "원천징수세율", "100분의")),
    ("definition_scope", ("정의", "범위", "대상", "포함")),
    ("calculation_rule", ("산출", "계산", "산정", "적용하여")),
    ("law_to_decree", ("시행령", "위임", "대통령령")),
    ("parallel_tax_law", ("병행", "동일 취지")),
)

# Markers of a direct citation.
DIRECT_CITE_MARKERS = (
    "직접 인용",
    "인용:",
    "역인용",
    "명시 인용",
    "확정 병행",
    "확정 연관",
)

# Addenda precedents.
PRECEDENTS = (
    ("corp_business_vehicle_future", "법인세법", ("업무용승용차", "손금불산입"), ("업무용승용차", "손금", "한도", "비용"), "사업연도", "장래효", "에 관한 적용례", "{jo_label}의 개정규정은 {law_ref} 시행 이후 최초로 개시하는 사업연도 분부터 적용한다.", "대표 선례: 법인세법 업무용승용차 관련비용 적용례 유형"),
    ("corp_tax_rate_future", "법인세법", ("세율",), ("세율", "과세표준", "인하", "상향", "법인세"), "사업연도", "장래효", "에 관한 적용례", "{jo_label}의 개정규정은 {law_ref} 시행 이후 개시하는 사업연도 분부터 적용한다.", "대표 선례: 법인세율 개정 적용례 유형"),
    ("income_tax_period_future", "소득세법", ("필요경비", "소득금액", "세액공제", "세액감면"), ("필요경비", "소득금액", "세액공제", "세액감면", "과세기간"), "과세기간", "장래효", "에 관한 적용례", "{jo_label}의 개정규정은 {law_ref} 시행 이후 개시하는 과세기간 분부터 적용한다.", "대표 선례: 소득세 과세기간 적용례 유형"),
    ("tax_return_filing_transitional", "", ("신고", "과세표준"), ("신고", "과세표준", "신고기한"), "신고", "부진정소급효", "에 관한 적용례", "{jo_label}의 개정규정은 {law_ref} 시행 이후 과세표준을 신고하는 경우부터 적용한다.", "대표 선례: 신고분 적용례 유형"),
    ("transaction_date_retroactive", "", ("양도", "취득", "공급", "거래", "소득"), ("양도", "취득", "공급", "거래", "발생"), "발생/거래", "장래효", "에 관한 적용례", "{jo_label}의 개정규정은 {law_ref} 시행 이후 발생하는 소득ㆍ거래분부터 적용한다.", "대표 선례: 거래ㆍ소득 발생일 적용례 유형"),
)

# Application basis -> sentence.
BASIS_TEMPLATES = (
    ("사업연도", "{law_ref} 시행 이후 최초로 개시하는 사업연도 분부터 적용한다."),
    ("과세기간", "{law_ref} 시행 이후 개시하는 과세기간 분부터 적용한다."),
    ("신고", "{law_ref} 시행 이후 과세표준을 신고하는 경우부터 적용한다."),
    ("지급/수령", "{law_ref} 시행 이후 지급하거나 수령하는 분부터 적용한다."),
    ("양도/취득", "{law_ref} 시행 이후 양도하거나 취득하는 분부터 적용한다."),
    ("공급", "{law_ref} 시행 이후 공급하는 분부터 적용한다."),
    ("발생/거래", "{law_ref} 시행 이후 발생하는 소득ㆍ거래분부터 적용한다."),
)

# Effect -> sentence.
EFFECT_TEMPLATES = (
    ("장래효", "{law_ref} 시행 이후 최초로 개시하는 사업연도 분부터 적용한다."),
    ("부진정소급효", "{law_ref} 시행 이후 과세표준을 신고하는 경우부터 적용한다."),
)

# Particles that do not begin a compound.
PARTICLES = (
    "이",
    "가",
    "을",
    "를",
    "은",
    "는",
    "의",
    "와",
    "과",
    "에",
    "도",
    "만",
    "로",
    "나",
    "에서",
    "으로",
    "부터",
    "까지",
    "마다",
    "처럼",
    "이나",
    "이며",
    "이고",
    "이면",
    "이라",
    "이라도",
    "이지만",
    "이라면",
    "이어서",
    "이어도",
    "와서",
    "와는",
    "와도",
    "과는",
    "과도",
    "는데",
    "은데",
    "에도",
    "에만",
    "로서",
    "로는",
    "로도",
    "로만",
    "에게",
    "에서는",
    "으로서",
    "부터는",
    "까지는",
    "이라는",
)

# Sections of a draft.
DRAFT_SECTIONS = ("지시문", "현행", "개정안", "부칙", "연관항")
