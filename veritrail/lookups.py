"""Word lists, maps and constants of the questionnaire domain.

Fixed values: every list below is part of the result contract (a different word
changes a score or a match), so the values are stated as they are, in their
natural order. All of them are defaults of operator parameters.
"""

# --- fixed values: answers, dimensions, ratings -----------------------------------------
YES, NO, NOT_APPLICABLE = "Sim", "Não", "N/A"
ANSWER_VALUES = [YES, NO, NOT_APPLICABLE]
YES_SPELLINGS = ["sim", "SIM"]
NO_SPELLINGS = ["Nao", "nao", "NAO", "não"]

DIMENSIONS = ["environmental", "social", "governance"]
DIMENSION_WEIGHTS = {"environmental": 0.35, "social": 0.30, "governance": 0.35}
DIMENSION_LABELS = {
    "environmental": "Ambiental",
    "social": "Social",
    "governance": "Governança",
}
AGENT_NAMES = {
    "environmental": "Agente Ambiental",
    "social": "Agente Social",
    "governance": "Agente Governança",
}
DEFAULT_AGENT = "Agente ESG"
RATING_BANDS = [(8.0, "A"), (6.0, "B"), (4.0, "C"), (2.0, "D")]
LOWEST_RATING = "E"

DEFAULT_JUSTIFICATION = "Não foi possível processar esta pergunta."
DEFAULT_SOURCE = "Documentos da empresa"
DEFAULT_DOCUMENT_NAME = "Documento"
NO_CONTEXT_TEXT = "Nenhum trecho relevante encontrado."

# --- fixed values: question complexity --------------------------------------------------
COMPLEX_PATTERNS = [
    "tendência", "trajetória", "últimos 3 anos", "últimos três anos",
    "melhoria nos últimos", "redução nos últimos", "evolução",
    "resposta satisfatória", "mitigação de danos",
    "qual participação", "representa qual", "mais de 50%", "mais de 20%",
    "corresponde a mais de",
    "eficácia", "efetividade", "avalie", "avaliação",
    "como a empresa", "de que forma", "descreva",
    "controvérsia severa", "controvérsia muito severa",
    "gestão socioambiental", "plano de ação", "estratégia",
    "metas quantitativas", "metas de redução",
    "integração de fatores", "cadeia de produção",
    "risco", "oportunidade", "cenários climáticos",
]
SIMPLE_PATTERNS = [
    "a empresa possui", "a empresa publica", "a empresa divulga",
    "a empresa está no", "a empresa tem", "a empresa participa",
    "a empresa é signatária", "a empresa reporta",
    "a empresa monitora", "a empresa realiza",
    "os compromissos abrangem", "o programa inclui",
    "ceo e presidente", "são a mesma pessoa",
    "são auditadas", "é auditada",
    "código de ética", "canal de denúncia",
    "política ou compromisso",
    "possui comitê", "possui conselho",
]
SIMPLE_MAX_WORDS = 15

# --- fixed values: keyword retrieval ----------------------------------------------------
STOP_WORDS = [
    "para", "como", "mais", "sobre", "qual", "quais", "pela", "pelo",
    "seus", "suas", "esse", "essa", "esses", "esta", "este", "sido",
    "cada", "ainda", "mesmo", "entre", "sendo", "outros", "outras",
    "muito", "pode", "deve", "onde", "apos", "forma", "tipo", "anos",
    "possui", "empresa", "tema", "seguintes", "temas", "relacionada",
]

# --- fixed values: sources that say nothing ---------------------------------------------
GENERIC_SOURCE_PATTERNS = [
    "nenhuma evidencia", "nenhuma evidência",
    "documentos analisados", "trechos fornecidos",
    "informação não encontrada", "informacao nao encontrada",
    "não encontrada", "nao encontrada",
    "n/a", "não aplicável", "nao aplicavel",
]

# --- fixed values: link discovery -------------------------------------------------------
LINK_KEYWORDS = [
    "sustentabilidade", "sustainability", "esg", "relatorio", "relatório",
    "politica", "política", "policy", "codigo", "código", "code",
    "governanca", "governança", "governance", "estatuto", "bylaws",
    "conselho", "board", "diretoria",
    "etica", "ética", "ethics", "conduta", "conduct", "compliance",
    "integridade", "integrity", "anticorrup",
    "diversidade", "diversity", "direitos humanos", "human rights",
    "saude", "saúde", "seguranca", "segurança", "safety",
    "fornecedor", "supplier", "cadeia",
    "ambiental", "environmental", "clima", "climate", "emiss",
    "residuo", "resíduo", "waste", "hidric", "hídric", "water",
    "energia", "energy", "biodiversidade",
    "fre", "formulario", "formulário", "anual", "annual",
    "integrado", "integrated", "indicador", "cvm",
    "inventario", "inventário", "ghg", "gee",
]
DOCUMENT_EXTENSIONS = [".pdf", ".xlsx", ".xls", ".docx"]
PDF_ATTRIBUTES = ["onclick", "data-href", "data-url", "data-src", "data-file", "data-download"]
PDF_IN_ATTRIBUTE_PATTERN = r"""(?i)(https?://[^\s'"<>]+\.pdf[^\s'"<>]*)"""
PDF_IN_SOURCE_PATTERN = r"""(?i)(https?://[^\s'"<>\\]+\.pdf(?:\?[^\s'"<>\\]*)?)"""
SIZE_SUFFIX_PATTERN = r"(?i)\s*\(?\d+\s*(kb|mb|gb)\)?$"
DOWNLOAD_SUFFIX_PATTERN = r"(?i)\s*-\s*download$"
NAME_EXTENSION_PATTERN = r"(?i)\.(pdf|xlsx|docx)$"
MIN_PAGE_CHARS = 100
PDF_BONUS = 3
EMBEDDED_LINK_TEXT = "Embedded Document"

# --- fixed values: page text ------------------------------------------------------------
DROPPED_TAGS = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "svg", "form"]
CONTENT_CLASS_PATTERN = "content|article|post|entry|main"
GARBAGE_PATTERNS = [
    r'"exception"\s*:', r'"trace"\s*:', r'"stacktrace"\s*:',
    r"Symfony\\", r"Laravel\\", r"500 Internal Server Error",
    r'"message"\s*:\s*"No query results',
    r"<noscript>.*enable javascript",
    r"__NEXT_DATA__",
]
FRAMEWORK_MARKS = ["react", "vue", "angular", "nuxt", "next", "__nuxt", "data-v-", "ng-app"]
MIN_USEFUL_CHARS = 500
BRAZILIAN_NUMBER_PATTERN = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?"
CHARS_PER_PAGE = 3000

# --- fixed values: sector -> industry class, first entry wins ---------------------------
SECTOR_CLASSES = {
    "Energia": "Energia",
    "Energy": "Energia",
    "Materiais": "Materiais",
    "Materials": "Materiais",
    "Papel e Celulose": "Materiais",
    "Celulose": "Materiais",
    "Mineracao": "Materiais",
    "Siderurgia": "Materiais",
    "Industrial": "Industrial",
    "Industrials": "Industrial",
    "Bens Industriais": "Industrial",
    "Consumo ciclico": "Consumo cíclico",
    "Consumer Discretionary": "Consumo cíclico",
    "Varejo": "Consumo cíclico",
    "Consumo nao ciclico": "Consumo não cíclico",
    "Consumer Staples": "Consumo não cíclico",
    "Alimentos": "Consumo não cíclico",
    "Bebidas": "Consumo não cíclico",
    "Saude": "Saúde",
    "Health Care": "Saúde",
    "Financeiro": "Serviços financeiros",
    "Financials": "Serviços financeiros",
    "Servicos financeiros": "Serviços financeiros",
    "Bancos": "Serviços financeiros",
    "Seguros": "Serviços financeiros",
    "Tecnologia": "Tecnologia da informação",
    "Information Technology": "Tecnologia da informação",
    "Comunicacoes": "Comunicações",
    "Telecomunicacoes": "Comunicações",
    "Communication Services": "Comunicações",
    "Utilities": "Utilities",
    "Utilidade publica": "Utilities",
    "Energia eletrica": "Utilities",
    "Saneamento": "Utilities",
    "Real estate": "Real estate",
    "Imoveis": "Real estate",
    "Construcao": "Real estate",
}
DEFAULT_SECTOR_CLASS = "Materiais"

# --- fixed values: workbook sheets ------------------------------------------------------
ADMIN_SHEETS = [
    "Capa", "Sumário", "Conceito&Orientações", "Dados da empresa", "Abrev_Temas",
    "Assinaturas", "Padronização_dados", "Padronização", "Notas",
]
QUESTION_ID_PATTERN = r"^(\d+\.\d+(?:\.\d+)*)"
UNSCORED_SHEETS = ["Controvérsias", "Materialidade", "Resultado"]

# --- fixed values: sizes ----------------------------------------------------------------
CHUNK_WORDS = 500
SENTENCE_SPLIT_FACTOR = 4
EMBEDDING_BATCH, EMBEDDING_CHARS = 20, 8000
QUESTION_BATCH = 5
SEARCH_DEPTH, COVERAGE_DEPTH = 20, 10
COVERAGE_GOOD, COVERAGE_PARTIAL, COVERAGE_NONE = "OK", "PARCIAL", "SEM DADOS"
SIMILARITY_THRESHOLD = 0.3
CONTEXT_CHUNKS, CONTEXT_CHARS = 20, 1200
SOURCE_CHUNKS = 5
JUSTIFICATION_CHARS, SOURCE_CHARS, IMPROVEMENT_CHARS = 800, 200, 300
IDLE_SECONDS, STARTUP_SECONDS, HEARTBEAT_SECONDS = 180, 300, 600
