"""Withholding-tax reference values (fixed values: law tables and wording)."""

from __future__ import annotations

SIMPLIFIED_DISCOUNT = "607.20"
FULL_REDUCTION_CEILING = "5000.00"
REDUCTION_CEILING = "7350.00"
FULL_REDUCTION = "312.89"
REDUCTION_CONSTANT = "978.62"
REDUCTION_FACTOR = "0.133145"

VERSION_2026 = "2026"
LEGAL_BASIS_2026 = "Lei nº 15.191/2025"
SOURCE_URL_2026 = "https://www.gov.br/receitafederal/pt-br/assuntos/meu-imposto-de-renda/tabelas/2026"
VALIDATED_ON_2026 = "2026-01-01"
# low, high (None is open), rate, deduction
BRACKETS_2026 = (
    ("0.00", "2428.80", "0", "0.00"),
    ("2428.81", "2826.65", "0.075", "182.16"),
    ("2826.66", "3751.05", "0.15", "394.16"),
    ("3751.06", "4664.68", "0.225", "675.49"),
    ("4664.69", None, "0.275", "908.73"),
)

COMPANY_LANDLORD_BRACKET = "não aplicável (locador PJ)"
COMPANY_LANDLORD_NOTE = (
    "IRRF não retido: aluguel pago a locador PJ não sofre retenção nesta modalidade (RF04)."
)
NOTE_PREFIX = "Rendimento bruto de %s, desconto simplificado de %s → base tributável %s."
NOTE_EXEMPT = "%s Faixa isenta: IRRF = R$ 0,00."
NOTE_REDUCED = "%s IRRF = %s × %s − %s = %s; reduzido em %s pela Lei nº 15.270/2025 → %s."
NOTE_PLAIN = "%s IRRF = %s × %s − %s = %s."
NEGATIVE_BASE = "Base de cálculo do IRRF não pode ser negativa."
LAST_MUST_BE_OPEN = "A última faixa da tabela deve ser aberta (maximo=None)."
ONLY_LAST_OPEN = "Apenas a última faixa pode ter maximo=None."
