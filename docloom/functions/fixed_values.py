"""Fixed values.

Word lists, patterns, labels and limits that must equal the published tool's
values for results to agree.  They are data, kept together in natural order;
no logic lives here.  Patterns are written for ``java.util.regex``.
"""

# --- limits -----------------------------------------------------------------
MAX_FILES = 20
MAX_FILE_BYTES = 25 * 1024 * 1024
BLOCK_CHARS = 6_000
LIST_CHARS = 3_000
BATCH_CHARS = 12_000
BATCH_BLOCKS = 8
MIN_TABLE_HEIGHT = 40
TITLE_CHARS = 120
ANNEX_TITLE_CHARS = 180
CAPS_ITEM_RATIO = 0.9
CAPS_TITLE_RATIO = 0.85
SUFFIX_MIN_BLOCKS = 5
SUFFIX_MIN_RATIO = 0.5
GROUNDED_RATIO = 0.5
GROUNDED_TASK_RATIO = 0.45
STEM_CHARS = 5
STEM_MIN_WORD = 4
AMBIGUOUS_SECTIONLESS_CHARS = 300
AMBIGUOUS_CHARS = 350
EXAMPLES_PER_TYPE = 5
STATUS_TTL = "1 hour"

# --- labels -----------------------------------------------------------------
T_ANNEX = "Padrão/Anexo"
T_TITLE = "Título/Subtítulo"
T_INFO = "Informação"
T_EXEC = "Execução"
T_IGNORE = "Ignorar"
OUTPUT_TYPES = (T_ANNEX, T_TITLE, T_INFO, T_EXEC)
TASK_TYPES = OUTPUT_TYPES + (T_IGNORE,)

L_TITLE = "Título"
L_SUBTITLE = "Subtítulo"
L_EXEC = "Execução"
L_INFO = "Informação"
LINE_TYPES = (L_TITLE, L_SUBTITLE, L_EXEC, L_INFO)

DOC_PE = "PE"
DOC_ANNEX_A = "Anexo A"
DOC_ANNEX_B = "Anexo B"
DOC_UNKNOWN = "Desconhecido"

MATRIX_CSV_COLUMNS = (
    "Item (Padrão)", "Descrição", "Tipo da Tarefa", "ID da Subtarefa",
    "Subtarefa (HTA)", "Descrição da tarefa",
)
MATRIX_SHEET_COLUMNS = (
    "Subtarefa (HTA)", "Item (Padrão)", "Descrição da tarefa (Padrão)",
    "Tipo da tarefa", "ID da Subtarefa", "Descrição da tarefa (HTA)",
)
BLOCK_CSV_COLUMNS = (
    "ordem_arquivo", "arquivo", "tipo_documento", "ordem_bloco", "tipo",
    "seção", "hierarquia", "conteúdo",
)
EMPTY_BLOCK_TEXT = "Bloco sem texto extraível no documento."

ACCEPTED_EXTENSIONS = (".pdf", ".doc", ".docx")
MAGIC_PDF_HEX = "255044462D"
MAGIC_DOC_HEX = "D0CF11E0A1B11AE1"
MAGIC_ZIP_HEX = "504B"

# --- character classes ------------------------------------------------------
BULLETS = "•·▪◦*"
DASHES = "-–—"
WS = r"[\s\x1c-\x1f]"
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# --- word lists -------------------------------------------------------------
KEYWORDS = (
    "objetivo", "aplicação", "descrição", "tabela", "como fazer", "porque fazer",
    "anexo", "registro", "execução", "atividade", "recursos", "itens críticos",
    "ações de controle", "p.p.n.t", "boletim",
)
NOTICE_PREFIXES = ("OBS", "OBSERVACAO", "ATENCAO", "LEMBRE-SE", "LEMBRE SE")
APPROVAL_PREFIXES = ("APROVADO POR", "GERIDO POR", "GESTAO DO DOCUMENTO")
UI_LABELS = (
    "ALT", "CONFIG", "FLOW COMP", "LIST", "METER", "OBS", "USER",
    "VALOR TOTALIZADO DO GAS",
)
TOC_TITLES = ("OBJETIVO", "APLICAÇÃO", "DESCRIÇÃO", "REGISTROS", "DEFINIÇÕES")
SECTION_NAMES = "OBJETIVO|APLICAÇÃO|DESCRIÇÃO|REGISTROS|DEFINIÇÕES"
GENERIC_CONTAINERS = (
    "ATIVIDADE", "DESCRICAO", "DETALHAMENTO DAS ATIVIDADES DO PROCESSO",
    "ETAPAS DE EXECUCAO DAS TAREFAS", "PROCEDIMENTO",
)
GENERIC_WORDS = (
    "atividade", "bloco", "contrato", "csv", "documento", "matriz", "numerada",
    "parser", "principal", "priorizacao", "regra", "secao", "subsecao",
)
# ordered: first prefix found (after the item number) decides the category
NAMED_CATEGORIES = (
    ("objetivo", "OBJETIVO"),
    ("aplicacao", "APLICACAO"),
    ("como_fazer", "COMO FAZER"),
    ("porque_fazer", "PORQUE FAZER"),
    ("registros", "REGISTRO"),
    ("definicoes", "DEFINIC"),
    ("recursos_necessarios", "RECURSOS NECESSARIOS"),
    ("itens_criticos", "ITENS CRITICOS"),
)
CATEGORY_ALIASES = (
    ("atividade_tabela", "atividade_tabela_2"),
    ("atividade_tabela", "atividade_anomalia"),
    ("anexo_documento", "anexo"),
    ("fragmento_interface", "ruido_fluxograma"),
    ("fragmento_interface", "ruido_metadado"),
)
DEFAULT_TASK_TYPE = {
    "padrao_documento": T_ANNEX,
    "secao_principal": T_TITLE,
    "titulo_tabela": T_TITLE,
    "objetivo": T_INFO,
    "atividade_tabela_2": T_TITLE,
    "atividade_anomalia": T_INFO,
    "como_fazer": T_EXEC,
    "porque_fazer": T_INFO,
    "fragmento_interface": T_IGNORE,
    "cabecalho_documento_repetido": T_IGNORE,
    "anexo_cabecalho_repetido": T_IGNORE,
    "cabecalho_tabela": T_IGNORE,
}
DETERMINISTIC_CATEGORIES = (
    "padrao_documento", "titulo_tabela", "atividade_tabela_2", "cabecalho_tabela",
    "objetivo", "aplicacao", "tabela_tecnica", "definicoes", "nao_aplicavel", "geral",
    "lista_informativa", "observacao", "recursos_necessarios", "registros",
    "responsavel_unidade", "set_intertravamento", "subsecao_numerada",
    "anexo_documento", "anexo_cabecalho_repetido", "cabecalho_documento_repetido",
    "fragmento_interface", "item_numerado_anexo", "instrucao_operacional",
    "etapa_operacional", "passo_tabela_operacional",
)
IMPERATIVES = {
    "aborte": "Abortar", "abra": "Abrir", "acione": "Acionar", "acople": "Acoplar",
    "aguarde": "Aguardar", "alinhe": "Alinhar", "anote": "Anotar", "aperte": "Apertar",
    "baixe": "Baixar", "clique": "Clicar", "continue": "Continuar", "digite": "Digitar",
    "escolha": "Escolher", "feche": "Fechar", "informe": "Informar",
    "inspecione": "Inspecionar", "instale": "Instalar", "interrompa": "Interromper",
    "isole": "Isolar", "levante": "Levantar", "ligue": "Ligar", "observe": "Observar",
    "posicione": "Posicionar", "preencha": "Preencher", "realize": "Realizar",
    "recoloque": "Recolocar", "retorne": "Retornar", "retire": "Retirar", "suba": "Subir",
    "teste": "Testar", "trave": "Travar", "utilize": "Utilizar", "varie": "Variar",
    "verifique": "Verificar",
}
GERUNDS = {
    "acompanhando": "Acompanhar", "alinhando": "Alinhar", "atuando": "Atuar",
    "definindo": "Definir", "direcionando": "Direcionar", "informando": "Informar",
    "lendo": "Ler", "monitorando": "Monitorar", "registrando": "Registrar",
    "retirando": "Retirar", "seguindo": "Seguir", "transferindo": "Transferir",
}

# verbs that open an action inside a sentence (row generation)
ACTION_VERBS = (
    r"(?:aborte|abortar|abra|abrir|acione|acionar|acople|acoplar|aguarde|aguardar|ajuste|"
    r"ajustar|alinhe|alinhar|anote|anotar|aperte|apertar|aplique|aplicar|atue|atuar|avalie|"
    r"avaliar|baixe|baixar|bloqueie|bloquear|clique|clicar|colete|coletar|comunique|"
    r"comunicar|continue|continuar|digite|digitar|escolha|escolher|feche|fechar|informe|"
    r"informar|inspecione|inspecionar|instale|instalar|interrompa|interromper|isole|isolar|"
    r"levante|levantar|ligue|ligar|observe|observar|posicione|posicionar|preencha|preencher|"
    r"realize|realizar|recoloque|recolocar|retorne|retornar|retire|retirar|suba|subir|teste|"
    r"testar|utilize|utilizar|varie|variar|confirmar|contatar|desligar|emitir|encaminhar|"
    r"entrar\s+em\s+contato|estabelecer|executar|iniciar|liberar|manter|medir|monitorar|"
    r"operar|parar|proceder|registrar|remover|reparar|restabelecer|seguir|sinalizar|"
    r"solicitar|tomar|transportar|travar|verificar)"
)
# verbs that make a block an instruction wherever they appear
IMPERATIVE_CUE = (
    r"\b(?:aborte|abortar|acompanhe|acompanhar|acople|acoplar|abra|abrir|acione|acionar|"
    r"aguarde|aguardar|alinhe|alinhar|anote|anotar|aperte|apertar|baixe|baixar|clique|clicar|"
    r"comunique|comunicar|confirme|confirmar|digite|digitar|escolha|escolher|feche|fechar|"
    r"informe|informar|inspecione|inspecionar|instale|instalar|interrompa|interromper|isole|"
    r"isolar|ligue|ligar|observe|observar|posicione|posicionar|preencha|preencher|realize|"
    r"realizar|recoloque|recolocar|retorne|retornar|retire|retirar|solicite|solicitar|suba|"
    r"subir|teste|testar|trave|travar|utilize|utilizar|verifique|verificar|varie|variar)\b"
)
# verbs that make a block an instruction at its very start
ACTION_START = (
    r"^\s*(?:\d+(?:\.\d+)+\.?\s+)?(?:abortar|abrir|acionar|acoplar|aguardar|ajustar|alinhar|"
    r"anotar|aplicar|atentar|atuar|avaliar|bloquear|coletar|comunicar|confirmar|contatar|"
    r"desligar|emitir|encaminhar|entrar\s+em\s+contato|estabelecer|executar|fechar|informar|"
    r"iniciar|inspecionar|instalar|interromper|isolar|liberar|ligar|manter|medir|monitorar|"
    r"operar|parar|posicionar|preencher|proceder|realizar|registrar|remover|reparar|"
    r"restabelecer|retirar|seguir|sinalizar|solicitar|tomar|transportar|verificar)\b"
)
ACTION_CUE = (
    r"\b(?:dever[aá]|dever[aã]o|deve-se|recomenda-se|abortar|abrir|aguardar|isolar|ligar|"
    r"realizar|solicitar|bloquear|acionar|informar\s+imediatamente|entrar\s+em\s+contato|"
    r"parar\s+os?|alinhar\s+para|estabelecer\s+(?:a\s+)?comunica[cç][aã]o|confirmar\s+que|"
    r"avaliar\s+(?:o|a)|coletar\s+(?:uma|a)|tomar\s+as\s+a[cç][oõ]es|informar\s+(?:ao|a|o)|"
    r"s[oó]\s+abrir|abrir\s+novo\s+registro)\b"
)
NEGATED_MODAL = r"\bn[aã]o\s+dev(?:e|em|er[aá]|er[aã]o)\b"

# --- line and block patterns (match at the start unless noted) --------------
PAGE_MARK = r"(?:INTERNA\s+)?página\s+\d+\s+de\s+\d+"
RULE_LINE = r"^[_\-]{3,}$"
NOISE_LINE = (
    r"^(?:PROPRIEDADE\s+D[AEO]\s+[^\s\d]+\s+PAGE\s+\d+\s+DE\s+NUMPAGES(?:\s+\d+)?"
    r"|LIST\s+\d+\s+\d+\s+OF\s+\d+|SHAPE\s+\\\*\s+MERGEFORMAT"
    r"|TTONT-KM3(?:\s*\([^)]*\))?\s*[0-9,\.]*|EMED-\d+\b.*|#?\s*INTERNA(?:\s*\\.*)?$)$"
)
SECTION = r"^(?:\d+\.|\d+\.\d+(?:\.\d+){0,6}\.?)\s+(?:[-–—]\s*)?.+"
STANDARD_ITEM = r"^\s*(\d+\.(?:\d+\.)*|\d+(?:\.\d+)+)(?=\s|[-–—]|$)"
TABLE_TITLE = r"^(?:tabela\s*\d+|quadro\s*\d+|anexo\s+[a-z])\b"
LIST_ITEM = r"^(?:[•·▪◦*-]|\d+[.)-]|\d+\s*[-–—])\s+\S+"
PROCESS_REFERENCE = r"^N\d+\s*[-–—]\s+"
DOCUMENT_CODE = r"^(?:PE|PG|PR|PP)-[A-Z0-9]+-\d{5}\b"
ANNEX_HEADING = r"^ANEXO\s+([A-Z]\d*)\b"
TABLE_HEADER = (
    r"^(?:O QUE FAZER|EXECUTANTE|ONDE REGISTRAR|ATIVIDADE|ASPECTO/PERIGO|"
    r"IMPACTO/RISCO|AÇÕES DE CONTROLE)$"
)
DOCUMENT_METADATA = (
    r"^(?:P\d{1,2}(?:\s*\|\s*P\d{1,2})+|INSTALAÇÃO\b|ÁREA\b|DATA\b|RESP(?:ONSÁVEIS)?\b"
    r"|NOME\b|MATR[IÍ]CULA\b|FUNÇÃO\b|GERÊNCIA\b|A[CÇ][AÃ]O\s+DE\s+RTA\b|FIGURA\s+\d+\b"
    r"|\d+\s+DE\s+\d+$|(?:SIM|NÃO|NAO|RESP\.?|N\.?A\.?)$|[A-Z]\.$)"
)
TECHNICAL_MARKER = (
    r"^(?:objetivo|aplicação|descrição|como fazer|porque fazer|registros|definições|"
    r"recursos necessários|itens críticos)\b"
)
NUMBERED_ITEM = r"^\s*(\d+(?:\.\d+)*\.?)\s*(?:[-–—]\s*)?(.*)$"
ALNUM_HEADING = r"^\s*(\d+[A-Z])\s*[-–—]\s*(.+)$"
RESPONSIBLE_CELL = (
    r"^(?:RESP\.?|OP[- ]?[A-Z0-9]+|CIOP(?:-[A-Z0-9]+)?|FSO(?:[- ]CIMA)?|BARCO\s+DE\s+APOIO)$"
)
ANNEX_OPERATIONAL_HEADING = (
    r"^\s*\d+(?:\.\d+)*\.?\s*(?:[-–—]\s*)?(?:ACOMPANHAR|CHECAR|INSPECIONAR|VERIFICAÇÃO|"
    r"VERIFICACAO)\b"
)
ANNEX_LETTER_ITEM = (
    r"(?s)^\s*(?:[•·▪◦*\-]\s*([A-Z])(?:\s*[.)]|\s+)|([A-Z])\s*[.)])\s*(.+)$"
)
STEP_ROW = r"(?s)^\s*PASSO\s+(\d+)\s*\|\s*(.+)$"
STAGE_ROW = r"^\s*ETAPA\s+(\d+)\s*[-–—:]\s*(.+)$"
TABLE_ACTIVITY = r"^\s*(\d+)\s*[-–—.]\s*(.+)"
NUMBERED_LIST_ITEM = r"^\s*\d+\s*[-–—]\s+\S+"
TECHNICAL_GROUP = r"^\s*Set'?s?\s+de\s+intertravamentos?\b"
TECHNICAL_PARAMETER = (
    r"^\s*(?:PSHH|PSH|PSL|PSLL|LSHH|LSH|LSL|LSLL|TSHH|TSH|TSL|TSLL|LAH|LAL)-?\w*\b"
)
NAMED_SECTION = r"^\d+\.\s+(?:" + SECTION_NAMES + r")$"
NUMBERED_TITLE = r"^\d+\.\d+(?:\.\d+)*\.?\s*[-–—]\s*\S+"
OUTSIDE_TABLE = r"^\d+(?:\.\d+)+\.?\s*[-–—]"
FIGURE_DETAIL = r"^FIGURA\s*\d+\s*[-–—:]\s*DETALHAMENTO\s+DAS\s+ATIVIDADES"
ANNEX_FILENAME = r"\bANEXO\s+([A-Z]\d*)\b(?:\s*[-–—:]\s*(.*))?$"
FILE_SUFFIX = r"\.(?:pdf|docx?|DOCX?)\s*$"
FLOWCHART = r"\bFLUXOGRAMA\b"
CONDITION_START = r"(?:Antes de|Após|Em caso|Caso|Se houver|Quando)\b"
CONDITION_PREFIX = (
    r"^(?:ap[oó]s\b|antes\s+de\b|caso\b|com\s+base\b|depois\s+de\b|durante\b|"
    r"em\s+casos?\b|enquanto\b|no\s+caso\b|nos\s+casos?\b|ocorrendo\b|"
    r"para\s+(?:o|a|os|as)\b|quando\b|se\b)"
)
TECHNICAL_NOUN = (
    r"(?:c[aâ]maras?|compressor(?:es)?|dutos?|equipamentos?|gasodutos?|linhas?|sistemas?|"
    r"tanques?|tubula[cç](?:[aã]o|[oõ]es)|v[aá]lvulas?|vasos?)"
)
TECHNICAL_NOUN_TAIL = r"(?:\s+(?:de|do|da|dos|das)\s+(?:\"[^\"]+\"|[\wÀ-ÿ-]+)){0,3}"
FEMININE_NOUN = r"^(?:c[aâ]mara|linha|tubula[cç][aã]o|v[aá]lvula)"
DOCUMENT_CODE_TITLE = (
    r"^((?:PE|PG|PR|PP)-[A-Z0-9]+-\d{5})\s*[-–—]\s*Versão\s*([0-9.]+)\s*[-–—]\s*"
    r"(?:Padrão\s+Ativo\s*)?(.*)$"
)
ANNEX_ITEM_PREFIX = r"^ANEXO\s+[A-Z]\d*\s*-\s*"
DOCUMENT_LIST_HEADING = (
    r"\b(?:LISTA\s+DE\s+|SEGUINTES\s+)?(?:DOCUMENTOS|REFERENCIAS)"
    r"(?:\s+(?:DE\s+)?[A-Z0-9 ]+)?$"
)
NUMERIC_HTA = r"^\d+(?:\.\d+)*\.$"
LIST_MARKER = (
    r"(?:^|(?<=\n)|(?<=:)|(?<=;))\s*([-–—•·▪◦*]|[a-z][.)])\s+"
)
PE_SECTION = r"^(?:## )?(\d+)\.\s*(?:" + SECTION_NAMES + r")\b"
MARKDOWN_HEADING = r"^\d+\.\s+[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ ]{3,}$"

# --- seed rules: name, order, scope, pattern, task type, category, example ---
SEED_RULES = (
    ("ruido_metadado_documento", 10, "geral",
     r"(?i)^\s*(?:INSTALAÇÃO|ÁREA|DATA|RESP(?:ONSÁVEIS)?|NOME|MATR[IÍ]CULA|FUNÇÃO|GERÊNCIA"
     r"|A[CÇ][AÃ]O\s+DE\s+RTA|FIGURA\s+\d+|\d+\s+DE\s+\d+).*$",
     T_IGNORE, "fragmento_interface", "INSTALAÇÃO P71 ÁREA: Manutenção DATA 22/12/2022"),
    ("ruido_fluxograma_interface", 20, "anexo_fluxograma",
     r"(?i)^\s*(?:SIM|NÃO|NAO|RESP\.?|N\.?A\.?|#?\s*INTERNA)\s*$",
     T_IGNORE, "fragmento_interface", "SIM"),
    ("cabecalho_documento_repetido", 30, "anexo",
     r"(?i)^\s*(?:PE|PG|PR|PP)-[A-Z0-9]+-\d{5}\b.*$",
     T_IGNORE, "cabecalho_documento_repetido", "PE-3UBS-01699"),
    ("anexo_cabecalho_repetido", 40, "anexo", r"(?i)^\s*ANEXO\s+[A-Z]\d*\b.*$",
     T_IGNORE, "anexo_cabecalho_repetido", "ANEXO M1"),
    ("cabecalho_tabela", 50, "geral",
     r"(?i)^\s*(?:O QUE FAZER|EXECUTANTE|ONDE REGISTRAR|ITEM|DESCRIÇÃO|RESPONSÁVEL).*$",
     T_IGNORE, "cabecalho_tabela", "O QUE FAZER | EXECUTANTE | ONDE REGISTRAR"),
    ("padrao_documento", 60, "documento_principal",
     r"(?i)^\s*(?:PE|PG|PR|PP)-[A-Z0-9]+-\d{5}\b.*$",
     T_ANNEX, "padrao_documento", "PE-3P53-00047 – Versão 14.00 – Padrão Ativo"),
    ("anexo_documento", 70, "anexo", r"(?i)^\s*ANEXO\s+[A-Z]\d*\b.*$",
     T_ANNEX, "anexo_documento", "ANEXO C - Instruções para partida"),
    ("secao_principal", 80, "documento_principal",
     r"(?i)^\s*\d+\.\s+(?:OBJETIVO|APLICAÇÃO|DESCRIÇÃO|REGISTROS|DEFINIÇÕES)\s*$",
     T_TITLE, "secao_principal", "1. OBJETIVO"),
    ("instrucao_operacional", 90, "geral",
     r"(?i)\b(?:verificar|confirmar|acionar|abrir|fechar|alinhar|realizar|informar|solicitar"
     r"|inspecionar|monitorar)\b",
     T_EXEC, "instrucao_operacional", "Verificar a pressão antes de iniciar."),
    ("lista_informativa", 100, "geral", "", T_INFO, "lista_informativa",
     "• Rádio transceptor UHF"),
    ("tabela_tecnica", 110, "tabelas_tecnicas", "", T_INFO, "tabela_tecnica",
     "Pressão da água na entrada | 70 kPa"),
    ("atividade_tabela_2", 120, "tabela_2", "", T_TITLE, "atividade_tabela_2",
     "1 - Partir a bomba"),
    ("como_fazer", 130, "tabela_2", r"(?i)^\s*COMO\s+FAZER\s*:", T_EXEC, "como_fazer",
     "COMO FAZER: abrir a válvula."),
    ("porque_fazer", 140, "tabela_2", r"(?i)^\s*PORQUE\s+FAZER\s*:", T_INFO, "porque_fazer",
     "PORQUE FAZER: evitar retorno de fluxo."),
)
