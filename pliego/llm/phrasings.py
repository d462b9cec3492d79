"""Sentences with invented personal data, to train and test the tagger beyond the contracts' own phrases.

A phrasing has slots: {N} a person, {L} a person's surname after a title, {S} a street address, {P} a phone, {E} an email
address, {I} an identity number; {T} a town, {C} a company, {Z} another capitalised term and {K} a file number are no
personal data. HELD_OUT phrasings, and the names of HELD_NAMES, are never trained on.
"""

from __future__ import annotations

import random
import re

KIND_OF = {"E": 1, "P": 2, "I": 3, "S": 4, "N": 5, "L": 5}
FIRST = "Lucía María Carmen Ana Isabel Laura Marta Elena Sara Paula Cristina Beatriz Rosa Pilar Teresa Julia Irene Raquel Silvia Mónica Nuria Alicia Rocío Inés Clara Eva Andrea Sonia Lorena Patricia Antonio José Manuel Francisco Juan David Javier Daniel Carlos Miguel Rafael Pedro Ángel Alejandro Fernando Pablo Sergio Luis Jorge Alberto Álvaro Diego Adrián Raúl Enrique Ramón Vicente Andrés Joaquín Ignacio Óscar Rubén Iván Víctor Tomás Emilio Gonzalo Hugo Mateo Bruno Leandro Fermín Anselmo Teodoro Ofelia Fermina Damián Casilda Leocadia João Tiago Rui Inês Joana Catarina Margarida Duarte Afonso Claire Sophie Camille Julien Mathieu Étienne Lucas Emma Olivia James Oliver Harry Emily Grace Thomas George Alice Henry".split()
HELD_NAMES = "Martina Valeria Noelia Esteban Jaime Mario Cayetano Eulalia Beltrán Filomena Vasco Leonor Pierre Margaux William Charlotte".split()
SURNAMES = "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Ramírez Serrano Blanco Molina Morales Suárez Ortega Delgado Castro Ortiz Rubio Marín Sanz Iglesias Medina Cortés Garrido Castillo Santos Lozano Guerrero Cano Prieto Méndez Cruz Herrera Peña Flores Cabrera Campos Vega Fuentes Carrasco Silva Costa Ferreira Pereira Oliveira Dubois Moreau Laurent Lefèvre Smith Jones Taylor Brown Wilson Walker Wright".split()
STREETS = ["Calle", "C/", "Avenida", "Avda.", "Plaza", "Pza.", "Paseo", "Camino", "Ronda", "Travesía", "Cuesta", "Carretera", "Rua", "Glorieta", "calle", "avenida", "plaza", "paseo"]
OF = ["", "", "", "de ", "del ", "de la ", "de los ", "de las "]
LEGAL = ["S.L.", "S.A.", "S.L.U.", "S.A.U.", "S. Coop.", "Ltd", "SARL", "Lda."]
TRADES = "Talleres Promociones Gestora Servicios Clínicas Hoteles Naviera Consultores Distribuciones Franquicias Transportes Bodegas Inmobiliaria Climatizaciones Editorial Panaderías".split()
TERMS = ["Registro de la Propiedad", "Código Civil", "Ley de Arrendamientos Urbanos", "Juzgado de Primera Instancia", "Ayuntamiento de {T}", "Tribunal Supremo", "Centro Comercial Las Lomas", "Edificio Torre Norte", "Plaza Mayor", "Colegio Santa Clara", "Boletín Oficial del Estado", "Cámara de Comercio", "Hospital San Rafael", "Galerías Doña Berta", "Hijos de Ramiro Cuesta", "Puerto Sarde", "Residencia Los Álamos", "Agencia Tributaria", "Semana Santa", "Unión Europea", "Banco Mediterráneo", "High Court", "Civil Code", "Code Civil", "Conselho Fiscal", "Recursos Humanos", "Acta Notarial", "Anexo Primero", "Don Quijote", "Avenida Central", "Sierra Morena", "Comité de Empresa", "LEASE AGREEMENT", "CONTRATO DE SERVICIOS", "MANAGEMENT AGREEMENT", "SALE AGREEMENT", "CLÁUSULA PRIMERA", "CONDICIONES GENERALES", "TERMS AND CONDITIONS", "CONTRATO DE PRESTAÇÃO", "CONTRAT DE BAIL", "OBJETO DEL CONTRATO"]

TRAIN = [
    "Ayer llamó {N} para preguntar por la fianza.", "Le ruego que avise a {N} antes del lunes.", "{N} no pudo asistir a la reunión.", "La reclamación la presentó {N}, vecina de {T}.", "Quien firma, {N}, acepta las condiciones.",
    "Según {N}, las obras terminaron en mayo.", "Hablé con {N} y con {N} sobre la avería.", "El piso de {N} está en {S}.", "Vive en {S}, en {T}, desde hace años.", "Su domicilio es {S}.", "La entrega se hará en {S}, preguntando por {N}.",
    "Mi número es el {P}.", "Puede llamarme al {P} por la tarde.", "Teléfono: {P}", "Móvil {P}, correo {E}", "Escríbame a {E} o llame al {P}.", "Mi correo es {E}.", "Contacto: {N} ({E})", "Para dudas, {E}.",
    "Identificada con DNI {I}.", "Mi NIE es {I} y vivo en {S}.", "DNI: {I}", "Pasaporte {I} a nombre de {N}.", "Número de la Seguridad Social {I}.", "{N}, {I}, {T}", "Titular: {N}. Documento: {I}.", "Asistentes: {N}, {N} y {N}.",
    "La señora {L} confirmó la cita.", "Sr. {L}, su solicitud ha sido admitida.", "Dra. {L} informó del resultado.", "El doctor {L} atiende los martes.", "Don {N} y doña {N} comparecen.", "Estimado {N}:", "Querida {N}:", "Un saludo,\n{N}", "Atentamente, {N}", "Firmado: {N}", "Fdo. {N}", "Notario: {N}", "Propietario {N}", "Inquilina {N}, con contrato {K}.",
    "El perito {N} midió la finca de {C}.", "La abogada {N} representa a {C}.", "Testigo {N}, domiciliado en {S}.", "Enviar copia a {N}, {S}, {T}.", "Avisen a {N} en el {P}.", "A la atención de {N}", "Recibí de {N} la cantidad de 300 euros.", "El coche es de {N}.", "Hermana de {N}, nacida en {T}.",
    "{C} contrató a {N} como gerente.", "La empresa {C} tiene su sede en {T}.", "El {Z} resolvió el recurso de {C}.", "Según el {Z}, la renta se revisa cada año.", "Reunión en {T} con {C} y el {Z}.", "El contrato {K} se rige por el {Z}.", "{Z} y {Z} quedan fuera.", "Las partes acuden al {Z} de {T}.", "La oficina de {T} cierra en Agosto.", "Expediente {K} de {C}.", "CIF B-12345678 de {C}.", "Cuenta ES12 1234 5678 9012 3456 7890 de {C}.", "Factura 20231234 del {Z}.", "En {T}, a 3 de Mayo de 2021.", "Visita de {C} a {T} el Lunes.",
    "Please call {N} on {P}.", "{N} signed the lease yesterday.", "Send the keys to {N} at {S}.", "My email is {E}.", "I spoke to {N} about the deposit.", "Mr {L} will attend.", "Ms {L} left a message.", "Tenant: {N}, passport {I}.", "The {Z} ruled against {C}.", "Regards, {N}", "The flat at {S} belongs to {N}.", "{C} is based in {T}.",
    "O senhor {L} telefonou ontem.", "A inquilina {N} mora na {S}.", "Contacte {N} pelo {P} ou {E}.", "Assinado por {N}.", "A {C} tem sede em {T}.", "Segundo o {Z}, a renda sobe.", "Falei com {N} sobre o contrato {K}.",
    "Madame {L} a signé le bail.", "Monsieur {N} habite {S}.", "Appelez {N} au {P}.", "Le bail de {N} porte le numéro {K}.", "La société {C} siège à {T}.", "Selon le {Z}, le loyer augmente.", "Écrivez à {E}.",
]
HELD_OUT = [
    "Anoche se presentó {N} en la portería con las llaves.", "Que conste que {N} devolvió los muebles.", "Gracias a {N} por resolver la incidencia.", "Acompañaba a {N} su cuñado.", "El recibo lo pagó {N} en efectivo.", "Pregunten por {N} en recepción.", "Nos mudamos a {S} en otoño.", "Recojan el paquete en {S}, por favor.", "La nueva tienda abre en {S}.",
    "Si hay problemas, marque {P}.", "Fax o teléfono {P} de la finca.", "Mande el justificante a {E} cuanto antes.", "Responda a {E} con copia al gestor.", "Renové el documento {I} el mes pasado.", "Con identidad acreditada mediante {I}.", "La doctora {L} pidió otra prueba.", "El señor {L} protestó por el ruido.",
    "Presidió la junta {N}, y actuó de secretaria {N}.", "Heredera única: {N}.", "Vendí la plaza de garaje a {N}.", "{N} and {N} share the flat.", "We are waiting for {N} to reply.", "The parcel went to {S} instead.", "Mrs {L} complained twice.", "Quem pagou foi {N}.", "Moro na {S} há dois anos.", "C'est {N} qui garde les clés.", "Le colis est parti au {S}.",
]

#: Parts that phrasings for training are put together from: before, around the slot, after.
BEFORE = "Ayer|Hoy|Esta mañana|Después|Al final|El martes|Como siempre|Además|Por eso|Luego|Entonces|Este año|Sin embargo|Ya se sabe que|Creo que|Me dicen que|Today|Later|Last week|I think|They say|Ontem|Depois|Acho que|Hier|Ensuite|On dit que".split("|")
AFTER = "|.| en la oficina.| sin avisar.| esta semana.|, que no contestó.|, como estaba previsto.| por escrito.| a primera hora.| y nadie más.| de la comunidad.| para el seguro.| on Friday.| as agreed.| without notice.| of the building.| amanhã.| sem aviso.| demain.| sans prévenir.".split("|")
AROUND = {
    "N": "vino {N}|llamaron a {N}|lo dijo {N}|la casa de {N}|una carta de {N}|con {N} y su madre|junto a {N}|contra {N}|por {N}|ante {N}|se reunió {N}|{N} pagó la renta|{N} envió las llaves|{N} y {N} vendieron el local|{N} solicita una copia|firmaron {N}, {N} y {N}|el hijo de {N}|actúa {N}|declaró {N}|fue elegida {N}|{N} tiene razón|{N} sent the form|{N} and {N} left early|a letter from {N}|the owner is {N}|with {N}|we met {N}|o filho de {N}|chegou {N}|{N} pagou tudo|avec {N}|c'était {N}|{N} a payé|la lettre de {N}",
    "L": "el señor {L} vino|la señora {L} avisó|el doctor {L} salió|la doctora {L} llamó|don {L} firma|Sra. {L}, pase|Dr. {L} opina|Mr {L} agreed|Mrs {L} called|Ms {L} wrote|Madame {L} est là|Monsieur {L} a dit|o senhor {L} veio|a senhora {L} ligou",
    "S": "vivo en {S}|nos vemos en {S}|el local de {S}|una finca sita en {S}|hay obras en {S}|la vivienda de {S}|envíe todo a {S}|the house at {S}|deliver it to {S}|uma loja na {S}|moram na {S}|il habite {S}|un colis pour le {S}",
    "P": "llame al {P}|marcar el {P}|el fax {P}|tel. {P}|teléfono {P}|al móvil {P}|en la centralita {P}|número {P}|WhatsApp {P}|o al {P}|call {P}|phone {P}|ring {P}|ligue {P}|tel {P}|au {P}",
    "E": "escriba a {E}|correo {E}|a la dirección {E}|copia a {E}|e-mail {E}|mail to {E}|write to {E}|para {E}|adresse {E}",
    "I": "con {I}|documento {I}|DNI {I}|NIF {I}|identidad {I}|mediante {I}|carné {I}|pasaporte {I}|afiliación {I}|ID {I}|passport {I}|pièce {I}",
    "C": "vino {C}|una carta de {C}|la sede de {C}|{C} pagó la renta|con {C} y {C}|the owner is {C}",
    "T": "en {T}|fuimos a {T}|el alcalde de {T}|cerca de {T}|lives in {T}|em {T}|à {T}",
    "Z": "según el {Z}|ante el {Z}|la sede del {Z}|{Z} y {Z}|el edificio de {Z}|the {Z}",
    "K": "el contrato {K}|expediente {K}|file {K}|factura {K}",
}
FREELY = 0.5


def built(rng: random.Random) -> str:
    """A phrasing put together from parts."""
    parts = [rng.choice(rng.choice(list(AROUND.values())).split("|")) for _ in range(rng.choice([1, 1, 1, 2, 2, 3]))]
    joined = parts[0] + "".join(rng.choice([" y ", ", ", " con ", "; ", " and "]) + p for p in parts[1:])
    before = rng.choice(BEFORE) + " " if rng.random() < 0.6 else ""
    return before + (joined if before or rng.random() < 0.4 else joined[:1].upper() + joined[1:]) + rng.choice(AFTER)


def invented(rng: random.Random) -> str:
    onsets, nuclei, codas = "b br c d f g gr j l ll m n p pr qu r s t tr v z".split(), "a e i o u ia ue".split(), ["", "", "n", "r", "s", "l"]
    return "".join(rng.choice(onsets) + rng.choice(nuclei) + rng.choice(codas) for _ in range(rng.randint(2, 4))).capitalize()


def surname(rng: random.Random) -> str:
    return rng.choice(SURNAMES) if rng.random() < 0.5 else invented(rng)


def person(rng: random.Random, firsts: list[str]) -> str:
    first = invented(rng) if firsts is FIRST and rng.random() < 0.12 else rng.choice(firsts)
    r = rng.random()
    name = f"{first} {surname(rng)}" if r < 0.4 else f"{first} {surname(rng)} {surname(rng)}" if r < 0.8 else f"{first} {rng.choice(firsts)} {surname(rng)}" if r < 0.88 else f"{surname(rng)} {surname(rng)}, {first}" if r < 0.94 else f"{first[0]}. {surname(rng)}"
    return name.upper() if rng.random() < 0.08 else name


def digits(rng: random.Random, shape: str) -> str:
    return re.sub("0", lambda _: str(rng.randrange(10)), shape)


def value(slot: str, rng: random.Random, firsts: list[str]) -> str:
    if slot == "N":
        return person(rng, firsts)
    if slot == "L":
        return surname(rng)
    if slot == "S":
        number = rng.choice([" 0", " 00", ", 00", ", 0", " n.º 00", ", núm. 0", ", 000"]) + rng.choice(["", "", "", ", bajo", ", 0.º B", ", piso 0, puerta 0", ", 0.º A"])
        name = rng.choice([invented(rng), f"{invented(rng)} {invented(rng)}", rng.choice(SURNAMES), f"{rng.choice(firsts)} {rng.choice(SURNAMES)}", rng.choice("Mayor Real Nueva Olmo Molino Fuente Sol Río Castillo Iglesia Estación Mercado".split())])
        return f"{rng.choice(STREETS)} {rng.choice(OF)}{name}{digits(rng, number)}"
    if slot == "P":
        return digits(rng, rng.choice(["600 000 000", "+34 900 000 000", "600000000", "910 00 00 00", "0034 600 000 000", "600-000-000", "(0034) 600-000-000", "600 00 00 00"]))
    if slot == "E":
        who = f"{rng.choice(firsts).lower()}{rng.choice(['.', '_', ''])}{invented(rng).lower()}{rng.choice(['', '7'])}"
        return f"{who}{rng.choice(['@', '@', '@', ' arroba ', '(at)', '[arroba]'])}{invented(rng).lower()}{rng.choice(['.', '.', '.', ' punto ', '[punto]'])}{rng.choice(['es', 'com', 'example', 'test', 'pt'])}"
    if slot == "I":
        letter = rng.choice("TRWAGMYFPDXBNJZSQVHLCKE")
        return digits(rng, rng.choice([f"00000000{letter}", f"00000000-{letter}", f"00.000.000-{letter}", f"X0000000{letter}", f"Y0000000-{letter}", "ABC000000", "00/00000000/00", "00 00000000 00", f"00000000 {letter}"]))
    if slot == "T":
        return rng.choice([invented(rng), f"{rng.choice(['Puerto', 'Villa', 'Santa', 'San', 'Torre'])} {invented(rng)}", f"{invented(rng)} del {invented(rng)}"])
    if slot == "C":
        return f"{rng.choice(TRADES)} {rng.choice([invented(rng), rng.choice(SURNAMES), f'{rng.choice(FIRST)} {rng.choice(SURNAMES)}'])} {rng.choice(LEGAL)}"
    if slot == "Z":
        return rng.choice(TERMS).replace("{T}", invented(rng))
    return digits(rng, rng.choice(["ARR/2021/00000000", "COM/2019/00000000", "EXP-2020-0000", "00000/2022"]))


def sentence(rng: random.Random, held_out: bool) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and its spans (begin, end, kind)."""
    firsts = HELD_NAMES if held_out else FIRST
    text, spans, last = "", [], 0
    pattern = rng.choice(HELD_OUT) if held_out else built(rng) if rng.random() < FREELY else rng.choice(TRAIN)
    for m in re.finditer(r"\{([A-Z])\}", pattern):
        text += pattern[last : m.start()]
        v = value(m.group(1), rng, firsts)
        if kind := KIND_OF.get(m.group(1)):
            spans.append((len(text), len(text) + len(v), kind))
        text += v
        last = m.end()
    return text + pattern[last:], spans
