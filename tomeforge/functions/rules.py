"""Default rule data. Every operator takes its rules as an argument; these are the Portuguese defaults.

Fixed values: word lists, names and patterns below must be as they are for results to agree.
"""

#: Acronyms and their expansions, in order (pattern, replacement).
ACRONYMS = [
    (r"(?i)\bPdF\s*(\d+(?:\s*[-–]\s*\d+)?)", "Poder de Fogo(PdF) $1"),
    (r"(?i)\bPdF\b(?!\s*\))", "Poder de Fogo(PdF)"),
    (r"(?i)\bFA\s*[=:]?\s*(\d+)", "Força de Ataque(FA) $1"),
    (r"(?i)\bFA\s*[=:]?\s*([FHRA]\+[\d+d+\s]+)", "Força de Ataque(FA) $1"),
    (r"(?i)\bFA\b(?!\s*\))", "Força de Ataque(FA)"),
    (r"(?i)\bFD\s*[=:]?\s*(\d+)", "Força de Defesa(FD) $1"),
    (r"(?i)\bFD\s*[=:]?\s*([FHRA+=\d\s]+)", "Força de Defesa(FD) $1"),
    (r"(?i)\bFD\b(?!\s*\))", "Força de Defesa(FD)"),
    (r"\bF(\d+(?:\s*[-–]\s*\d+)?)\b", "Força(F) $1"),
    (r"\bH(\d+(?:\s*[-–]\s*\d+)?)\b", "Habilidade(H) $1"),
    (r"\bR(\d+(?:\s*[-–]\s*\d+)?)\b", "Resistência(R) $1"),
    (r"\bA(\d+(?:\s*[-–]\s*\d+)?)\b", "Armadura(A) $1"),
    (r"\bF\b(?!\s*\))", "Força(F)"),
    (r"\bH\b(?!\s*\))", "Habilidade(H)"),
    (r"\bR\b(?!\s*\))", "Resistência(R)"),
    (r"\bA\b(?!\s*\))", "Armadura(A)"),
    (r"(?i)\bPV\s*[=:]?\s*(\d+)", "Pontos de Vida(PV) $1"),
    (r"(?i)\bPVs\b(?!\s*\))", "Pontos de Vida(PV)"),
    (r"(?i)\bPV\b(?!\s*\))", "Pontos de Vida(PV)"),
    (r"(?i)\bPM\s*[=:]?\s*(\d+)", "Pontos de Magia(PM) $1"),
    (r"(?i)\bPMs\b(?!\s*\))", "Pontos de Magia(PM)"),
    (r"(?i)\bPM\b(?!\s*\))", "Pontos de Magia(PM)"),
    (r"(?i)\b(\d+)\s*PEs?\b", "$1 Pontos de Energia(PE)"),
    (r"(?i)\bPEs\b(?!\s*\))", "Pontos de Energia(PE)"),
    (r"(?i)\bPE\b(?!\s*\))", "Pontos de Energia(PE)"),
    (r"(?i)\bCD\s*[=:]?\s*(\d+)", "Classe de Dificuldade(CD) $1"),
    (r"(?i)\bCD\b(?!\s*\))", "Classe de Dificuldade(CD)"),
]
#: Where a match of an acronym rule may begin.
ACRONYM_STARTS = r"(?=[PFHRACpfc\d])\b"
#: Behind a mark that no acronym rule takes or looks at: what stands there begins anew for all of them.
ACRONYM_CUTS = r"(?<=[.,;!?])"

#: Header spellings and the column each stands for.
HEADERS = {
    "FOR": "forca", "FORÇA": "forca", "F": "forca", "FORCA": "forca", "STR": "forca",
    "HAB": "habilidade", "HABILIDADE": "habilidade", "H": "habilidade", "DES": "habilidade", "DESTREZA": "habilidade", "DEX": "habilidade",
    "RES": "resistencia", "RESISTÊNCIA": "resistencia", "R": "resistencia", "RESISTENCIA": "resistencia", "CON": "resistencia", "CONSTITUIÇÃO": "resistencia",
    "ARM": "armadura", "ARMADURA": "armadura", "A": "armadura", "DEF": "armadura", "DEFESA": "armadura",
    "PV": "pv", "PVS": "pv", "VIDA": "pv", "HP": "pv",
    "PM": "pm", "PMS": "pm", "MANA": "pm", "MP": "pm",
    "CUSTO": "custo_pm", "CUSTO PM": "custo_pm", "CUSTOPM": "custo_pm", "CUSTO_PM": "custo_pm",
    "CÍRCULO": "circulo", "CIRCULO": "circulo", "NÍVEL": "circulo", "NIVEL": "circulo",
    "DURAÇÃO": "duracao", "DURACAO": "duracao", "DURAÇAO": "duracao",
    "ALCANCE": "alcance", "ALC": "alcance",
    "ESCOLA": "escola", "ELEMENTO": "elemento", "ELEM": "elemento",
    "PE": "pe", "PREÇO": "preco", "PRECO": "preco", "CUSTO PE": "pe",
    "BÔNUS": "bonus", "BONUS": "bonus", "BÔNUS DE ATAQUE": "bonus",
    "DANO": "dano", "DAN": "dano", "DAMAGE": "dano",
    "NOME": "nome", "NOM": "nome", "NAME": "nome",
    "DESCRIÇÃO": "descricao", "DESCRICAO": "descricao", "DESC": "descricao",
    "TIPO": "tipo", "TIP": "tipo",
    "HABILIDADES": "habilidades_especiais", "HAB. ESPECIAIS": "habilidades_especiais", "ESPECIAL": "habilidades_especiais", "REQUISITO": "requisitos",
}

#: Column sets that tell the kind of a table: (kind, headers, fewest of them), in order.
TABLE_KINDS = [
    ("stats", ["F", "H", "R", "A", "PV", "PM", "FOR", "HAB", "RES", "ARM"], 3),
    ("magias", ["CUSTO", "PM", "DURAÇÃO", "ALCANCE", "ESCOLA", "ELEMENTO", "CÍRCULO", "CIRCULO"], 2),
    ("equipamentos", ["PE", "PREÇO", "BÔNUS", "BONUS", "DANO", "DEFESA", "ALCANCE"], 2),
    ("pericias", ["CUSTO", "PERÍCIA", "PERICIA", "HABILIDADE", "REQUISITO"], 2),
]

#: Valid ranges of numeric columns.
RANGES = {"forca": (1, 100), "habilidade": (1, 100), "resistencia": (1, 100), "armadura": (0, 50), "pv": (1, 1000), "pm": (0, 500), "circulo": (1, 5), "custo_pm": (0, 100)}

#: Words of a description that tell a combat spell.
COMBAT_WORDS = ["dano", "ataque", "ferimento", "destruir", "matar"]

#: Question openings that are not part of what is asked for.
QUESTION_PREFIXES = ["o que é ", "o que e ", "o que o ", "o que a ", "o que os ", "o que as ", "como funciona ", "quais ", "qual ", "quem é ", "quem e ", "explique ", "o que são ", "o que sao "]

#: Domain terms and the phrases that expand them.
SYNONYMS = {
    "fênix": ["Fênix magia elemental fogo", "ave Fênix conjuração renascimento chamas"],
    "mortos-vivos": ["mortos-vivos necromancia criaturas mortas", "morto-vivo esqueleto zumbi"],
    "magia elemental": ["magia elemental fogo água terra vento"],
    "conjuração": ["conjurar criatura invocação magia"],
}

#: Abilities that raise and lower a strength score.
STRONG_ABILITIES = [
    "aceleração", "resistência à magia", "voo", "invisibilidade", "paralisia", "magia elemental", "ataque múltiplo", "fúria", "membros elásticos", "regeneração",
    "imortal", "invulnerabilidade", "veneno", "armadura extra", "deflexão", "ataque especial",
]
WEAK_ABILITIES = ["inculto", "modelo especial", "vulnerabilidade", "fobia", "dependente"]

#: Texts that look like names and are none.
NOT_NAMES = [
    "FA", "FD", "PV", "PM", "PE", "XP", "PO", "PP", "PC", "PL", "Alcance", "Duração", "Custo", "Função", "Além disso", "Por exemplo", "No entanto",
    "Sentidos Especiais", "Código de Honra", "Combate", "O jogo", "A regra", "T Alpha", "por exemplo", "Se falhar", "Se passar", "veja abaixo", "veja adiante",
    "por turno", "por rodada", "por minuto", "ou mais", "ou menos", "ou seja", "NÃO", "SIM", "não", "sim", "você pode", "você pode gastar", "você deve",
    "isto é", "a saber", "Exemplo", "Exigências", "RPG", "para cada", "do Manual", "e assim por diante", "de altura", "no entanto", "Por outro lado",
    "pelo custo normal em", "Magias", "Na verdade", "na verdade", "Na Verdade", "Na prática", "na prática", "Em geral", "em geral", "A seguir", "a seguir",
    "De acordo", "de acordo", "Em resumo", "em resumo", "T Alpha pg", "a pg", "Por isso", "por isso", "APENAS", "QUALQUER", "TODAS", "sua escolha",
    "Se for bem", "arredondado para baixo", "Escola", "Por fim",
]

#: Phrases that are no names, and fragments that parsing leaves.
FRAGMENTS = [
    r"(?i)^(se\s+(falhar|passar)|veja\s+(abaixo|adiante)|por\s+(turno|rodada|minuto)|ou\s+(mais|menos|seja)|voc[eê]\s+pode|voc[eê]\s+deve|isto\s+[ée]|a\s+saber|"
    r"para\s+cada|do\s+Manual|e\s+assim\s+por\s+diante|de\s+altura|no\s+entanto|por\s+outro\s+lado|pelo\s+custo\s+normal|"
    r"Na\s+verdade|Na\s+pr[áa]tica|Em\s+geral|A\s+seguir|De\s+acordo|Em\s+resumo)$",
    r"^[a-záéíóúâêîôûãõç]+\s+[A-ZÁÉÍÓÚ]",
    r"^[FHRA]-$",
    r"(?i)^(padrão|tipo|modelo|exemplo)\s+",
    r"-$",
    r"(?i)^(e\s+|ou\s+|de\s+|da\s+|do\s+|em\s+|no\s+|na\s+)[A-ZÁÉÍÓÚ]",
    r"(?i)^.*\b(pg|p[áa]g|p[áa]gina)\s*\d*$",
    r"(?i)^a\s+at[eé]",
    r"(?i)^arredondado",
    r"(?i)^por\s+isso$",
    r"(?i)^(para|sem)\s+",
    r"^[A-Z]{4,}$",
    r"(?i)^(sua|se)\s+",
    r"(?i)^capacidade\s+de",
    r"(?i)permanente.*alcance$",
    r"(?i)^com\s+metade\s+do",
    r"(?i)^Elemental\s+da?$",
    r"(?i)^por\s+fim$",
    r"^a\s+",
    r"(?i)^uma\s+vez\s+por",
    r"(?i)^ao\s+inv[eé]s\s+de",
    r"(?i)^comer\s+ou",
    r"(?i)^[ée]\s+automaticamente",
    r"(?i)^eles\s+gastam",
]

#: Words that make no proper noun, and kinds of items without a name of their own.
PHRASE_WORDS = (
    "se falhar passar veja abaixo adiante por turno rodada ou mais menos seja não sim você pode gastar deve isto é saber função exemplo exigências"
).split()
ITEM_KINDS = "arma armadura escudo poção pocao anel amuleto bastão bastao cajado varinha pergaminho livro mapa chave equipamento".split()

#: Contexts that state a rule, not a property.
PHANTOMS = r"(?i)\b(teste\s+de|deve\s+ser|se\s+falhar|se\s+passar|rolagem\s+de|jogador\s+deve)\b"

_STATS = r"(?i)\b(F[:\s]*\d+[\- ]*H[:\s]*\d+[\- ]*R[:\s]*\d+[\- ]*A[:\s]*\d+)\b"
#: Property patterns by type; group 1 is the value.
PROPERTIES = {
    "monstro": {
        "stats": _STATS,
        "pv": r"(?i)\bPV[:\s]*(\d+)\b",
        "pm": r"(?i)\bPM[:\s]*(\d+)\b",
        "initiative": r"(?i)iniciativa[:\s]*([^\n,.]{3,30})",
        "immunities": r"(?i)imune[s]?\s+a[:\s]*([^\n,.]{3,50})",
        "weaknesses": r"(?i)(?:fraqueza[s]?|vulnerabilidade[s]?)[:\s]*([^\n,.]{3,50})",
    },
    "magia": {
        "cost_pm": r"(?i)custa?[:\s]*(\d+)\s*PM",
        "school": r"(?i)escola[:\s]*([^\n,.]{3,20})",
        "element": r"(?i)elemento[:\s]*([^\n,.]{3,20})",
        "duration": r"(?i)dura[cç][aã]o[:\s]*([^\n,.]{3,30})",
        "range": r"(?i)alcance[:\s]*([^\n,.]{3,30})",
        "damage": r"(?i)(\d+d\d+(?:\s*\+\s*\d+)?)",
    },
    "item": {"preco_pe": r"(?i)(\d+)\s*PEs?", "bonus": r"(?i)bônus[:\s]*([+-]?\d+)", "stats": _STATS},
}

_SIDE = r"[A-Za-záéíóúâêôãõçÀ-ÿ\s\-']+?"
_WIDE = r"[A-Za-záéíóúâêôãõçÀ-ÿ0-9\s\-'+]+?"
_STOP = r"(?:\.|,|;|\n|$)"
#: Relation patterns in order (relation, pattern); of one group, the entity itself is the source.
RELATIONS = [
    ("is_a", rf"(?i)({_SIDE})\s+é\s+(?:um|uma|uns|umas)?\s*(?:tipo\s+de\s+)?({_SIDE}){_STOP}"),
    ("is_a", rf"(?i)({_SIDE})\s+são\s+({_SIDE}){_STOP}"),
    ("cost_pm", rf"(?i)({_SIDE})\s+custa\s+(\d+)\s*PM"),
    ("cost_pm", rf"(?i)({_SIDE})\s+gasta\s+(\d+)\s*PM"),
    ("cost_pm", r"(?i)custo\s*:?\s*(\d+)\s*PM"),
    ("requires", rf"(?i)({_SIDE})\s+requer\s+({_WIDE}){_STOP}"),
    ("requires", rf"(?i)({_SIDE})\s+necessita\s+([A-Za-záéíóúâêôãõçÀ-ÿ0-9\s\-']+?){_STOP}"),
    ("school", rf"(?i)escola\s*:?\s*({_SIDE}){_STOP}"),
    ("element", rf"(?i)elemento\s*:?\s*({_SIDE}){_STOP}"),
    ("weakness", rf"(?i)({_SIDE})\s+é\s+fraco\s+contra\s+({_SIDE}){_STOP}"),
    ("effect", rf"(?i)({_SIDE})\s+causa\s+({_SIDE}){_STOP}"),
    ("effect", rf"(?i)({_SIDE})\s+inflige\s+({_SIDE}){_STOP}"),
]

#: Portuguese function words.
STOP_WORDS = "a o e de da do das dos em no na nos nas um uma uns umas para por com sem que se os as ao aos à às ou".split()
#: What marks a chunk as one of spells, creatures or items, and the stats in it: fixed values.
HINTS = {
    "magia_has_cost_pm": r"(?iu)(custa?|gasta?|gasto)\s*[:]?\s*(\d+)\s*(PM|pontos?\s*de\s*man[áa])",
    "magia_has_element": r"(?iu)(elemento|elemental)\s*[:]?.*?(fogo|[áa]gua|ar|terra|luz|trevas|gelo|rel[âa]mpago|natureza)|(escola|escolas)\s*[:]?.*?(elemental|branca|negra|arcana|divina|ilusionismo|necromancia)",
    "magia_has_school": r"(?iu)(escola|escolas)\s*[:]?.*?(elemental|branca|negra|arcana|divina|ilusionismo|necromancia)",
    "monstro_has_stats": r"(?iu)\bF\s*[:.]?\s*(\d+)[-–]?\d*\s*[,;]?\s*H\s*[:.]?\s*(\d+)[-–]?\d*\s*[,;]?\s*R\s*[:.]?\s*(\d+)[-–]?\d*\s*[,;]?\s*A\s*[:.]?\s*(\d+)[-–]?\d*\b",
    "monstro_has_pv": r"(?iu)\b(PV|pontos?\s*de\s*vida)\s*[:.]?\s*(\d+)\b",
    "item_has_preco": r"(?iu)(\d+)\s*(PEs?|PO|PP|PC|PL)\b",
    "item_has_bonus": r"(?iu)b[ôo]nus\s*[:]?.*?([+-]?\d+)\s*(em\s+)?(FA|FD|PV|PM|teste|dano)",
}
STATS = r"(?iu)\b(?:F|Força|H|Habilidade|R|Resistência|A|Agilidade)[\s:]*\d+|\bPV\s*:?\s*\d+|\bPM\s*:?\s*\d+"
#: Words by which a query is one for a kind of text, in this order, and what marks a text as one of a kind: fixed values.
QUERY_TYPES = {
    "MAGIA": ["magia", "feiti", "escola", "pm", "custa"],
    "MONSTRO": ["monstro", "criatura", "ghoul", "dragão", "dragao", "vampiro", "zumbi"],
    "ITEM": ["item", "equipamento", "espada", "armadura", "anel"],
}
TEXT_TYPES = {"MONSTRO": r"(?iu)\b[FHRA]\s*[:=]\s*\d", "ITEM": r"(?iu)\b\d+\s*PE\b|preço|preco", "MAGIA": r"(?iu)magia|escola"}
#: What OCR leaves in stat lines, and what stands there (pattern, replacement), in order: fixed values.
DISPLAY_FIXES = [
    (r"(\d+)-1\s+5\b", "$1-15"),
    (r"(\d+)-1\s+(\d)\b", "$1-1$2"),
    (r"(?i)\bII\s+TO\b", "AGI"),
    (r"(?i)\bDE\s+XO\b", "DEX 0"),
    (r"(?i)\bPE\s+R\b", "PER"),
    (r"(?i)\bFR\s+S-", "FR 5-"),
    (r"(?i)['\"]+\.\)?ú111\s*", "Só "),
    (r"(?i)['\"]+\.\)?[úu]1+1*\s*", "Só "),
    (r"(?i)#!?[\s\\]+taques", "#Ataques"),
    (r"(?i)#!?[\s\\]+aques", "#Ataques"),
    (r"(?i)#\s*Ataques\s+fll", "#Ataques [1]"),
    (r"(\d+)°10\b", "$1%"),
    (r"(\d+)°\s*(\d+)", "$1%"),
    (r"(?i)\bli\s+F(\d)", " F$1"),
    (r"\s{2,}", " "),
    (r"\s+\.", "."),
    (r"\s+,", ","),
]
