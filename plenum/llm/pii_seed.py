"""A small labelled table of personal information for the tagger of `pii`, written for this project.

Each row is a sentence pattern.  Fields in braces are filled in by rule, and the fields named P (person),
E (e-mail), T (telephone), I (identity number) and A (street address) carry labels.  Lower-case fields are
the look-alikes that must stay unlabelled.

Names of persons, streets and places are put together letter by letter, new ones for each row, by the same
rule: a word by itself never tells which of them it is, so the tagger has to learn the words around it.
"""

from __future__ import annotations

import random
import re

# Letters that open, carry and close a syllable; names mix the alphabets, as people of everywhere write in.
LATIN = {
    "en": ("b br bl c ch cl cr d dr f fl fr g gl gr h j k l m n p ph pl pr qu r s sh sk sl sp st t th tr v w wh y z".split(), "a e i o u ai ea ee ie oo ou y".split(), ["", "", "", *"b ck d ff g l ll m n nd ng nt p r rd rk rn rt s ss st t th x".split()]),
    "es": ("b c ch d f g j l ll m n ñ p qu r s t v z br tr gr".split(), "a e i o u á é í ó ie ue ia".split(), ["", "", "", *"n r s l z d".split()]),
    "pt": ("b c ç d f g j l lh m n nh p r s t v x z br tr".split(), "a e i o u ã á ê ó õe ei ou ão".split(), ["", "", "", *"s r m l z".split()]),
    "pl": ("b c ch cz d dz f g j k l ł m n ń p r rz s sz ś t w z ż ź prz trz".split(), "a e i o u y ą ę ó ie ia".split(), ["", "", "", *"k n r s w cz sz ł m j".split()]),
    "xx": ("b bh d dh g gh h j k kh kw l m mb n nd ng nk ny o r s sh sr t ts v y zh ö ü".split(), "a aa e i o u ei oe uu ä ö ü å".split(), ["", "", "", *"n ng k m r h l t".split()]),
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Given names that are ordinary words too: only the words around tell.
AMBIGUOUS = "April Art Bill Carol Chance Chase Dawn Faith Frank Gene Grace Grant Guy Hope Hunter Iris Ivy Joy June Lily Mark Mason Max May Mercy Miles Nick Olive Pat Penny Rich Rob Rose Ruby Sandy Skip Summer Sunny Violet Will".split()
_STREET = "Street St St. Avenue Ave Ave. Road Rd Rd. Lane Ln. Drive Dr Dr. Court Ct Ct. Place Terrace Crescent Close Boulevard Blvd Blvd. Parkway Pkwy Way Square Circle Trail".split()
_TOP = "com org net edu test example invalid info".split()
_MONTHS = "January March May June August September October November Jan. Aug. Sept. Oct.".split()

PATTERNS = {
    "en": """My name is {P} and I speak for {n} households in {place}.
My name is {P} and I speak for {n} households in {place}
I am {P} from {place}.
I am {P} from {place} and I came last year too.
Please call me {P}.
Contact {P} about the next hearing in {place}.
Contact {P} at {E} or {T}.
Contact {P} at {T} or {E}.
Call {T} and ask for {P}, {place} office hours only.
Text {P} on {T} after {time} please.
Rev. {P} of {place} wants to {do}.
Dr. {P} from {place} {school} told us {when}.
Mrs. {P} and {P} asked the {body} about {code}.
Mr. {P} said nothing {when}.
Ms. {P} and {P} asked about {thing}.
{P} and {P} carpool from {place}.
{P} asked when {place} {school} would reopen.
{P} spoke about {thing} at {place} {school}.
{P} told the {body} about {thing}.
My daughter {P} rides route {n}.
My son {P} walks to {place} {school}.
My neighbor {P} waited {n} days at {place} {school}.
This is signed by {P}, parent at {place} {school}.
Thanks, {P}.
Best, {P}
Sincerely, {P}
From: {P} <{E}>.
From: {P} <{E}>
Cell: {T} / mail: {E}.
You can reach me at {E} before {date}.
Write to {E} about {code}.
Email {E} with questions.
My number is {T}, evenings in {place} are best.
My number is {T}.
Call me at {T} {when}.
Phone {T} or write to {E}.
I live at {A} near {place} {school}.
I live at {A}.
Send the reply about {code} to {A}.
Send it to {A}
We moved from {A} to {A} {when}.
My mother at {A} missed the notice for {place} {school}.
The puddle outside {A} never drains.
My address is {A}.
Mail goes to {A} {when}.
They asked for my {idword} {I} at the {place} desk.
They asked for my {idword}: {I} at the {place} desk.
My {idword} {I} is on the form for {place} {school}.
My {idword} is {I} is on the form for {place} {school}.
Look it up under {idword} {I}, filed on {date}.
Look it up under {idword} no. {I}, filed on {date}.
My {idword} #{I} was copied {when}.
My {idword}: {I} is printed on the letter.
The {place} Board of Education should {do}.
The {place} campus should {do}.
Thanks to the {eponym} volunteers, {place} managed {n} weeks without complaint.
The {eponym} reopened in {place} on {date}.
I am writing as a member of the {eponym} to ask that every hearing stay public.
As a supporter of the {eponym} I want these remarks placed in the record.
The St. {place} stop lost {n} riders {when}, vs. {n} at {place} {school}.
The corner of {place} Street and St. {place} Avenue floods {when}.
{place} Road floods {when}.
Mark the {place} crossing and grace the yard with a light.
Keep the {place} annex open in May and June.
May the board grant {place} {n} extra days.
Will power alone cannot {do}.
Will the {body} {do} in {place}, or must we return {when}?
Case no. 2026-{d4} covers room {n}-B at {place} {school}.
Case number {d4}-{d4} is open.
Budget line 312-{d4}-08 pays for {thing}.
Budget line 312-{n}-08 pays for {thing}.
Budget line 312-{d1},{d3}-08 pays for {thing}.
Invoice 00{d3}-77 lists {money} for {place}.
Invoice 00{d1},{d3}-77 lists {money} for {place}.
Invoice 00{d4}-77 lists {money} for {place}.
Bus {n} and bus 17 left {place} at {time}, {n}.{d1} miles away.
Ward {n} needs {d1},{d3} more seats before {date}.
Ward {n} needs {d4} more seats before {date}.
Call the office at {time} about {code}.
Call the office {when}.
Unit tests at {place} {school} start in week {n}.
Follow @{place}rides for updates on {thing}.
Email us the notes about {place} {school}.
The ratio was 20:1 at {place} {school} on 2026-09-12.
Grades 3-5 at {place} {school} scored 88/100 on {code}.
Version {n}.{d1} of {code} leaves out {place} entirely.
Ward clerks in {place} logged {d4} calls, e.g. about {thing}, {when}.
Ward clerks in {place} logged {d1},{d3} calls, e.g. about {thing}, {when}.
We spent {money} on stopgaps for {place} while the {body} debated {code}.
With {money} left, the {body} could {do} at {place} tomorrow.
Last year {place} {school} had {n} aides; this year it has {n} and nobody trusts the drill.
The {time} van to {place} {school} skipped {place} again {when}.
The doors at {place} {school} opened only at {place} time, {time}.
In {place} the last shuttle of {code} left at {time}.
It took {when} to learn that {code} covers {place} and not {place} {school}.
As noted in {code} (see No. {n}), staff cry in the supply room around {place}.
About {n}.{d1} percent of grandparents in {place} mentioned {thing} {when}.
On {date} the {body} heard {d4} remarks from {place}, most of them on {thing}.
On {date} the {body} heard {d1},{d3} remarks from {place}, most of them on {thing}.
The {body} promised {place} a fix by {date}, yet trust keeps eroding.
Could someone from the {body} meet caregivers at {place} {school} at {time}?
What we need in {place} is simple: {do}, then report back by {date}.
Please {do} at {place} {school} before {date}.
At {place} {school} I counted {n} cases of {thing} {when}.
How many of the {d4} seats at {place} {school} are for our tenants group?
How many of the {d1},{d3} seats at {place} {school} are for our tenants group?
Because of {thing}, two kids slipped on the steps at {place} and {n} households feel baffled.
Why does {place} wait {n} days when {place} {school} waits {n}.{d1}?
I support the plan for {place} {school}... and still {thing} stays.
My cousin at {place} {school} waited over a year and got only {code} in reply.
Nobody at {place} {school} could explain {thing} or where the {money} went.
To be fair, the {body} did call {place} {when}, but absences doubled.
If you {do}, then caregivers around {place} would be less ignored.
I am worn down about {thing}, especially {when} at {place} {school}.
Many renters from {place} asked the {body} to {do}, approx. {n} times by my count.
“Come back later?” asked one speaker from {place} {when}.
A sign at {place} {school} reads "We hear you!" and it stayed up.
Dear {P}, thank you for the letter about {thing}.
Attn: {P}, {body}.
Signed, {P}
Yours, {P}
Regards, {P} and {P}.
According to {P}, the {body} never answered.
I spoke with {P} {when} about {thing}.
My brother {P} and my aunt {P} came along.
The letter was sent by {P} on {date}.
{P}, who lives at {A}, asked about {thing}.
{P} lives at {A} and can be reached at {T}.
We met {P} at the {eponym} {when}.
Her name is {P} and she teaches at {place} {school}.
Ask {P} or the {body} about {code}.
It was {P}'s idea to {do}.
{noun} from {place} asked the {body} to {do}.
{noun} and {noun} waited at the {eponym} {when}.
{noun} in {place} mentioned {thing}.
The {eponym} is closed {when}.
The {noun} {noun} at {place} {school} needs {n} chairs.
Welcome to {place}, said the {noun} on the bus.
{place} and {place} share route {n}.
Mrs. {place} Primary is not a person here, said the {body}.
The {eponym} pool opens at {time}.
They said "not yet" and "no, not now" and closed {code}.
The {noun} at {place} said 'wait. not now.' and closed {code}.
They answered 'no. come back later.' and {noun} left {place}.
I am quietly hopeful about {thing}, and so is the {body}.
Several {noun} near {place} {school} waited {n} minutes.
Half of the {noun} at {place} never read {code}.
Older people from {place} asked the {body} to {do}.
We plan around guesses... and still {thing} stays.
Please read this aloud to the {body}.
Twelve weeks in a row the {noun} near {place} stayed dark.""",
    "es": """Me llamo {P} y represento a {n} familias de {place}.
La Sra. {P} habló en {place} {when}.
El Sr. {P} habló en {place} {when}.
Doña {P} preguntó por {thing}.
Mi correo es {E}, vivo cerca de {place}.
Llámenme al {T} o escriban a {E}.
Mi teléfono es {T}.
Mi documento {I} consta en la oficina de {place}.
Mi DNI {I} está en el expediente.
Vivo en {A}, a {n} minutos de {place}.
Manden la carta a {A}.
Vivo en {A}.
La Sra. directora de {place} dijo {when} que {thing} costaría {n},{d1} millones.
El núm. {d4} del registro de {place} menciona {thing}.
La ruta {n} ya no pasa por {place} y nadie confía en el plan {when}.
A las {h}:{m} la reunión de {place} seguía con {thing} y {n} asientos libres.
¿Cuándo van a publicar las actas en {place}, si ya son {d4} quejas?
Los choferes juntaron {d4} firmas en {place} para ampliar el horario.
Mi hija espera en {place} unos {n} minutos {when} y los niños llegan tarde.
Gracias a los vecinos de {place} por reparar la entrada, aunque faltan manos en la cocina.
Si quieren reparar la entrada, empiecen por {place}, p. ej. con el aula {n}.
No entiendo por qué todos preguntan lo mismo en {place} mientras sobran {d4} dólares.
Pedimos publicar las actas en la escuela {place} antes del día {n}.
En {place} las cuidadoras aguantan {thing} y por eso las clases se llenan, según conté {n} veces.
El martes pasado conté {n} personas en {place} hablando de {thing}.
En {place} muchas madres aguantan {thing}.
En {place} varias familias y los mayores esperan {n} minutos {when}.
En {place} nadie sabe quién decide.
¡Basta de {thing} en {place}!
Según la directora de {place}, {thing} sigue igual.""",
    "pt": """Meu nome é {P} e falo por {n} famílias de {place}.
O Sr. {P} falou em {place} {when}.
A Sra. {P} falou em {place} {when}.
Dona {P} perguntou por {thing}.
Meu e-mail é {E}, moro perto de {place}.
Liguem para {T} ou escrevam para {E}.
Meu telefone é {T}.
Meu documento {I} está na secretaria de {place}.
Moro na {A}, a {n} minutos de {place}.
Moro na {A}.
A Dra. da unidade {place} disse {when} que {thing} custaria {n},{d1} milhões.
O item {d4} da ata de {place} não explica {thing}.
A linha {n} já não passa por {place} e ninguém confia no plano {when}.
Às {h}:{m} a reunião de {place} ainda discutia {thing} com {n} lugares vazios.
Quando vão publicar as atas em {place}, se já são {d4} reclamações?
Os motoristas juntaram {d4} assinaturas em {place} para traduzir o folheto.
Minha filha espera em {place} uns {n} minutos {when} e o pátio fica escuro.
Obrigado a as professoras de {place} por ouvir os jovens, embora os idosos ficam de fora.
Desde o outono contei {n} pessoas em {place} falando sobre {thing}.
Em {place} os motoristas aguentam {thing} e por isso as aulas enchem.
Em {place} ninguém sabe quem decide.
Chega de {thing} em {place}!""",
    "pl": """Nazywam się {P} i mówię w imieniu {n} rodzin z {place}.
Pani {P} zabrała głos w {place} {when}.
Pan {P} zabrał głos w {place} {when}.
Mój adres e-mail to {E}, szkoła {place}.
Proszę dzwonić pod {T} lub pisać na {E}.
Mój numer to {T}.
Mój PESEL {I} jest w aktach placówki {place}.
Mój numer dowodu {I} jest w aktach.
Mieszkam przy {A}, szkoła {place} jest {n} minut stąd.
Mieszkam przy {A}.
Dyr. placówki {place} mówił, że koszt to ok. {n},{d1} mln, a nikt nie ufa planom.
Punkt {d4} planu dla {place} zawiera {thing}.
Linia nr {n} omija {place} {when} i na boisku jest ciemno.
O godz. {h}:{m} zebranie w {place} trwało, a {n} miejsc było wolnych.
Kierowcy zebrali {d4} podpisów w {place}, żeby opublikować protokoły.
Trzeba np. dodać napisy w {place}, zanim znów dzieci się spóźniają po raz {n}.
Nie rozumiem, czemu tracimy godziny pracy w {place}, gdy zostało {d4} zł.
Dziękuję, że rodzice z {place} chcą kupić zeszyty, choć minęło {n} dni.
W szkole {place} opiekunowie znoszą {thing}, dlatego klasy są przepełnione już {n} raz.
Prosimy zatrudnić psychologa w {place} do {n} dnia miesiąca.
W {place} nikt nie wie, kto decyduje.
Dziękuję, że opiekunowie z {place} chcą dodać napisy.
Nowi uczniowie z {place} i sąsiedzi z {place} czekają.
Szkoła {place} jest {n} minut stąd.
Dzieci spóźniają się w {place}, a rodzice w {place} czekają {n} minut.
Trzeba naprawić wejście i dodać światło w {place}.
Kiedy wreszcie ktoś zdecyduje kupić zeszyty w {place}, skoro jest {d4} skarg?""",
    "zh": """我叫{P}，代表{place}的{n}户家庭。
{P}老师{when}在{place}发言。
{P}先生{when}在{place}发言。
我的邮箱是{E}，欢迎{place}的老师联系。
请拨打{T}，离{place}不远。
我的学号{I}已经交给{place}办公室。
我的身份证号{I}已经登记。
我住在{A}，离{place}学校{n}分钟。
我住在{A}。
{place}的主任说费用大约是{n}.{d1}万元，可是没有人相信计划。
记录第{d4}号提到{place}，却没有解释课本不够。
{n}路车不再经过{place}，{when}孩子们经常迟到。
晚上{h}:{m}，{place}的会议还没有结束，空着{n}个座位。
老师们在{place}收集了{d4}个签名，希望翻译传单。
感谢{place}的老师们愿意修好大门，虽然等了{n}天。
{place}学校的司机师傅一直忍受走廊没有灯，所以操场一片漆黑，我数过{n}次。
我不明白为什么{place}剩下{d4}元，大家反复问同样的问题。
“操场一片漆黑！”{place}的老师们在{h}:{m}喊道。
请在第{n}天之前到{place}公布会议记录。
{place}已经有{d4}条投诉，你们什么时候才能加上字幕？
{when}我在{place}看到{n}个人在谈论来信没人回。
希望{place}学校再请一位数学老师。
请{place}加一位心理老师，还有一位体育老师。
{P}老师说{place}的实验室空着。
{P}女士{when}在{place}发言，{P}没有来。
我们的班主任老师和校长先生都没有回答。
{place}的老师说没有人回答。
{place}已经等了{n}天，{place}学校也一样。
邻居们和夜班的父母在{place}等了{n}天。
几位祖母在{place}说{n}路车不来。""",
    "hi": """मेरा नाम {P} है और मैं {place} के {n} परिवारों की ओर से बोल रहा हूँ।
श्री {P} ने {place} में बात की।
मुझसे {T} पर या {E} पर संपर्क करें, {place} केंद्र।
मेरी पहचान संख्या {I} {place} कार्यालय में दर्ज है।
मैं {A} में रहता हूँ, {place} से {n} मिनट दूर।
डॉ. साहब ने {place} में कहा कि खर्च {n}.{d1} लाख होगा।
बस संख्या {n} अब {place} नहीं जाती, इसलिए वसंत से हमारा काम छूटता है।
शाम {h}:{m} बजे {place} की बैठक चल रही थी और {n} कुर्सियाँ खाली थीं।
शिक्षक ने {place} में {d4} हस्ताक्षर जुटाए।
कृपया {place} में {n} तारीख से पहले फाटक ठीक करें।
मुझे समझ नहीं आता कि {place} में {d4} रुपये बचने पर भी बच्चे देर से पहुँचते हैं।
{place} से {d4} शिकायतें आ चुकी हैं, आप कब कहेंगे कि कापियाँ खरीदें?
{place} में दादा-दादी बंद लिफ्ट झेल रहे हैं और हमारा काम छूटता है, मैंने {n} बार गिना।
कुछ {noun} {noun} ने {place} में {noun} की।
कृपया {place} में {noun} {noun} करें।
नए छात्र ने {place} में बात की और अभिभावक ने फाटक के बारे में पूछा।
परीक्षा से पहले मैंने {place} में {n} लोगों को किताबों की कमी पर बात करते सुना।""",
    "ar": """اسمي {P} وأتحدث باسم {n} أسرة في {place}.
تحدث السيد {P} في {place} {when}.
تحدثت السيدة {P} في {place} {when}.
اتصلوا بي على {T} أو {E} قرب {place}.
رقم الهوية {I} مسجل في مكتب {place}.
أسكن في {A} على بعد {n} دقيقة من {place}.
قال د. المدير في {place} إن الكلفة {n}.{d1} مليون.
لم تعد الحافلة رقم {n} تمر من {place} ولا أحد يثق بالخطة {when}.
في الساعة {h}:{m} كان اجتماع {place} مستمرا وبقي {n} مقعدا فارغا.
جمع السائقون في {place} {d4} توقيعا من أجل نشر المحاضر.
نرجو إصلاح المدخل في {place} قبل اليوم {n}.
متى سيتم نشر المحاضر في {place} وقد وصلت {d4} شكوى؟
لا أفهم لماذا نخسر ساعات العمل في {place} مع بقاء {d4} دينار.
في مدرسة {place} يعاني السائقون من الممر الضيق ولذلك تمتلئ الصفوف، وقد عددتها {n} مرة.
{when} رأيت في {place} {n} شخصا يتحدثون عن نقص الكتب.
نرجو {noun} {noun} في {place}.
نرجو {noun} {noun} {noun} في {place} قبل اليوم {n}.
متى سيتم {noun} {noun} في {place}؟
متى سيتم {noun} {noun} {noun} في {place} وقد وصلت {d4} شكوى؟
قال د. {noun} في {place} إن {noun} {noun}.
نرجو ترجمة المنشور في {place}.
نرجو فتح الباب الخلفي في {place} وشراء المقاعد.
متى سيتم شراء الدفاتر في {place}؟
متى سيتم تعيين معلم جديد أو إعادة الموقف في {place}؟
اسمي {P} وأنا من {place}.
قال السيد {P} إن {place} بعيدة.""",
}

_THING = {"en": "the late bus;the broken buzzer;the fare change;the tiny print;the unsent letters;the counselor waiting list;the driver shortage;the shared therapist;the quiet policy shift;the missing ramp;the unheated shuttle;the narrow ramp;the unpaid tutoring hours", "es": "la puerta rota;el autobús tardío;la lista de espera;las cartas sin respuesta;el pasillo sin luz;la consejera ausente", "pt": "a rampa estreita;o ônibus atrasado;as cartas sem resposta;o elevador parado;a fila de espera", "pl": "wąski podjazd;ciemny korytarz;zepsutą bramę;spóźniony autobus;listy bez odpowiedzi"}
_WHEN = {"en": "last Tuesday;after the vote;since the merger;every rainy morning;before the first bell;shortly after pickup;at the start of term;during the June session;over the long weekend;once the snow melted;on the second evening;in the middle of exams", "es": "después de la votación;cada mañana de lluvia;el martes pasado;antes del examen;en plena asamblea;al empezar el curso;este otoño;desde la primavera", "pt": "depois da votação;toda manhã de chuva;na terça passada;antes da prova;desde o outono;nesta primavera", "pl": "przed egzaminem;w zeszły wtorek;po głosowaniu;tej jesieni;od wiosny;na początku semestru;w każdy deszczowy ranek", "zh": "上周二;今年秋天;春天以来;考试之前;投票之后;刚开学时;每个下雨的早晨", "hi": "वसंत से", "ar": "يوم الثلاثاء الماضي;بعد التصويت;قبل الامتحان;منذ الربيع;في كل صباح ماطر"}
_DO = "fix the gate;raise driver pay;publish arrival figures;open the storeroom audit;translate the flyer;hire a second math teacher;send reminders by text;share the drill results;test the tracking app;keep one calendar;widen the ramp;log every question;offer large print;move to a step-free room;caption the recording;split the long loop;light the back path;warn us before a cancellation".split(";")
_BODY = "planning staff;transport unit;ombuds team;budget committee;hearing clerk;district board;ward office;enrollment window;grants office;facilities desk;principal;curriculum lead".split(";")
_SCHOOL = "Elementary;High School;Middle School;Primary;Academy;Library;campus;annex;Field House;Learning Center;Park entrance;College".split(";")
#: What is often named after a person, and words that stand in titles of other things.
_HALL = "Hall;Library;Field;Park;Garden;Center;Gym;Chapel;Museum;Clinic;Foundation;Bridge;Tower;House;Bakery;Fund;Auditorium;Pool;Station;Theater;Avenue;Street school;Memorial".split(";")
_TITLE = "Open;Fair;Walk;Safe;Bright;Green;Second;First;Common;Public;Good;Better;Doors;Rooms;Together;Future;Voices;Steps;Roads;Start;Summer;Reading;Winter;Community;Twelve;Family".split(";")
_DRIVE = "drive;pledge;postcard;program;reader;committee;campaign;project;fair;session;period;week;club;series".split(";")
_IDWORD = "SSN;social;Social Security number;social security;driver's license;licence;license;passport;passport number;student ID;student number;pupil ID;member ID;benefits card;benefits number;state ID;medicaid number;case member number;national ID;insurance number;ID".split(";")


class _Fill:
    """Fills the fields of a pattern; the generator decides every choice."""

    def __init__(self, rng: random.Random, language: str) -> None:
        self.r, self.language = rng, language

    def pick(self, listed: list[str] | str) -> str:
        return self.r.choice(listed.split(";") if isinstance(listed, str) and ";" in listed else listed)

    def digits(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def word(self, least: int = 1, most: int = 3) -> str:
        """An invented word, capitalised."""
        r = self.r
        onset, vowel, coda = LATIN[self.language if self.language in LATIN and r.random() < 0.75 else r.choice(list(LATIN))]
        n = r.randint(least, most)
        out = "".join((r.choice(onset) if k or r.random() < 0.85 else "") + r.choice(vowel) + (r.choice(coda) if k == n - 1 or r.random() < 0.4 else "") for k in range(n))
        return (out if len(out) > 1 else out + r.choice("nrslt")).capitalize()

    def han(self, k: int) -> str:
        """Chinese characters of the first level of the old national standard, whose rows are 16 to 55."""
        return "".join(bytes([self.r.randint(0xB0, 0xD6), self.r.randint(0xA1, 0xFE)]).decode("gb2312") for _ in range(k))

    def hindi(self, n: int) -> str:
        r = self.r
        return "".join(r.choice("कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह") + r.choice(["", "", "ा", "ि", "ी", "ु", "ू", "े", "ो", "ं"]) for _ in range(n))

    def arabic(self, n: int) -> str:
        return "".join(self.r.choice("ابتثجحخدذرزسشصضطعغفقكلمنهويى") for _ in range(n))

    def surname(self) -> str:
        one, k = self.word(), self.r.random()
        if k < 0.1:
            return one + "-" + self.word()
        if k < 0.15:
            return self.pick(["O'", "D'", "Mc", "O’"]) + one
        return self.pick(["de ", "van ", "von ", "al-", "da "]) + one if k < 0.18 else one

    def P(self) -> str:
        r = self.r
        if self.language == "zh":
            return self.han(r.choice((2, 3, 3, 3)))
        if self.language == "hi":
            return f"{self.hindi(r.randint(2, 4))} {self.hindi(r.randint(2, 5))}"
        if self.language == "ar":
            return f"{self.arabic(r.randint(3, 5))} {self.pick(['ال', 'ال', ''])}{self.arabic(r.randint(3, 7))}"
        first, k = self.pick(AMBIGUOUS) if r.random() < 0.08 and self.language == "en" else self.word(), r.random()
        if k < 0.2:
            first = self.pick(LETTERS) + "."
        elif k < 0.3:
            first += f" {self.pick(LETTERS)}."
        last = self.surname()
        if self.language in ("es", "pt") and r.random() < 0.3:
            last += " " + self.surname()
        return f"{first} {last}"

    def E(self) -> str:
        r = self.r
        local = self.word(1, 2).lower() + self.pick(["", ".", "_", "-"]) + self.word(1, 3).lower() + self.pick(["", "", str(r.randrange(1000))]) + self.pick(["", "", "", "+" + self.word().lower()])
        local = "".join(c if c.isascii() else "e" for c in local)
        domain = "".join(c if c.isascii() else "a" for c in ".".join(self.word().lower() for _ in range(r.choice((1, 1, 2))))) + "." + self.pick(_TOP)
        k = r.random()
        if k < 0.1:
            return f"{local} [at] {domain}"
        if k < 0.2:
            return f"{local} (at) {domain.replace('.', ' (dot) ')}"
        if k < 0.23:
            return f"{local} at {domain.replace('.', ' dot ')}"
        text = f"{local}@{domain}"
        return text.upper() if k > 0.93 else text

    def T(self) -> str:
        a, b, c = str(self.r.randint(201, 989)), self.digits(4), self.digits(3)
        form = self.pick(["{a}-{c}-{b}", "({a}) {c}-{b}", "{a}.{c}.{b}", "{a}{c}{b}", "+1 {a} {c} {b}", "1-{a}-{c}-{b}", "{c}-{b}", "+44 7{a} {b}00", "+44 7700 900{c}", "020 7946 {b}", "{a}-{c}-{b} ext. {e}", "+48 {a} {c} {a}", "{a} {c} {b} x{e}"])
        return form.format(a=a, b=b, c=c, e=self.r.randrange(10, 9999))

    def I(self) -> str:  # noqa: E743
        r, n = self.r, self.digits
        if self.language == "pl":
            return n(11) if r.random() < 0.8 else self.pick(LETTERS) + self.pick(LETTERS) + self.pick(LETTERS) + n(6)
        if self.language == "zh":
            return n(10) if r.random() < 0.7 else n(18)
        if self.language != "en":
            return f"{n(3)}-{n(2)}-{n(4)}" if r.random() < 0.55 else f"{self.pick('XYZ')}{n(7)}-{self.pick(LETTERS)}"
        return self.pick([f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}", n(9), f"{self.pick(LETTERS)}{n(3)}-{n(4)}-{n(4)}", f"{self.pick(LETTERS)}{n(8)}", n(8), f"{self.pick(LETTERS)}-{n(8)}", f"{self.pick(LETTERS)}{self.pick(LETTERS)}{n(9)}"])

    def A(self) -> str:
        r = self.r
        if self.language == "es":
            name = self.place()
            return self.pick([f"Av. {name} núm. {r.randrange(1, 9999)}, piso {r.randrange(1, 40)}", f"calle {name} {r.randrange(1, 300)}", f"Calle {name}, {r.randrange(1, 300)}, 3.º B", f"Calle {name} {r.randrange(1, 300)}", f"Paseo {name} {r.randrange(1, 90)}"])
        if self.language == "pt":
            name = self.place()
            return self.pick([f"Rua {name}, {r.randrange(1, 900)}", f"Travessa {name}, n.º {r.randrange(1, 99)}", f"Av. {name}, {r.randrange(1, 9999)}, apto {r.randrange(1, 50)}"])
        if self.language == "pl":
            name = self.place()
            return self.pick([f"ul. {name} {r.randrange(1, 200)}/{r.randrange(1, 40)}", f"ul. {name} {r.randrange(1, 99)}, 00-{r.randrange(100, 999)} {self.place()}", f"os. {name} {r.randrange(1, 40)} m. {r.randrange(1, 60)}", f"al. {name} {r.randrange(1, 99)}"])
        if self.language == "zh":
            name = self.han(r.randint(2, 3))
            return self.pick([f"{name}巷{r.randrange(1, 99)}弄{r.randrange(1, 60)}号", f"{name}街{r.randrange(1, 900)}号{r.randrange(1, 40)}栋{r.randrange(1, 6)}单元{r.randrange(101, 4002)}室", f"{name}路{r.randrange(1, 300)}号"])
        if self.language == "hi":
            name = self.place()
            return self.pick([f"मकान नंबर {r.randrange(1, 700)}, {name} मार्ग", f"{r.randrange(1, 99)}/{r.randrange(1, 20)} {name} रोड"])
        if self.language == "ar":
            name = self.place()
            return self.pick([f"شارع {name} رقم {r.randrange(1, 900)}", f"{r.randrange(1, 900)} شارع {name}، شقة {r.randrange(1, 40)}"])
        if r.random() < 0.1:
            return f"P.O. Box {r.randrange(100, 9999)}, {self.word()}"
        unit = self.pick(["", "", "", f" #{r.randrange(1, 40)}", f", Apt {r.randrange(1, 40)}{self.pick('ABC')}", f" Apt. {r.randrange(1, 40)}", f", Unit {r.randrange(1, 40)}", f", Suite {r.randrange(1, 40)}0"])
        town = self.pick(["", "", f", {self.word()}", f", {self.word()} {self.digits(5)}"])
        way = self.pick(["", "", "", "N. ", "W ", "E ", "South ", "North "])
        if r.random() < 0.12:
            return f"{self.pick(['Flat', 'Apt'])} {r.randrange(1, 40)}, {r.randrange(1, 200)} {self.word()} {self.pick(_STREET)}"
        return f"{r.randrange(1, 9999)} {way}{self.word()} {self.pick(_STREET)}{unit}{town}"

    def place(self) -> str:
        r = self.r
        if self.language in ("es", "pt"):
            return self.word() + (" de " + self.word() if r.random() < 0.6 else "")
        if self.language == "pl":
            return self.word() + ("-" + self.word() if r.random() < 0.6 else "")
        if self.language == "zh":
            return self.han(2) + (self.pick("东西南北上下前后里外中新") if r.random() < 0.5 else self.han(r.randint(0, 1)))
        if self.language == "hi":
            return (f"{self.hindi(r.randint(2, 4))} " if r.random() < 0.5 else "") + self.hindi(r.randint(3, 6)) + ("-" + self.hindi(r.randint(3, 6)) if r.random() < 0.5 else "")
        if self.language == "ar":
            return f"{self.arabic(r.randint(4, 8))} {self.pick(['و', ''])}{self.arabic(r.randint(4, 8))}" + (f" {self.arabic(r.randint(5, 7))} {r.randrange(100, 999)}" if r.random() < 0.6 else "")
        return self.word() + (" " + self.word() if r.random() < 0.08 else "")

    def eponym(self) -> str:
        """A hall, programme or body that is named like a person, or by ordinary words."""
        k = self.r.random()
        if k < 0.55:
            name = self.pick(AMBIGUOUS) if self.r.random() < 0.4 else self.word()
            return f"{name} {self.word()} {self.pick(_HALL)}" if self.r.random() < 0.4 else f"{name} {self.pick(_HALL)}"
        name = self.pick(AMBIGUOUS) if self.r.random() < 0.3 else self.pick(_TITLE)
        return f"{name} {self.pick(_TITLE)} {self.pick(_DRIVE)}" if k < 0.8 else f"{name} {self.pick(['of the', 'for'])} {self.pick(_TITLE)} {self.pick(_DRIVE)}" if k < 0.86 else f"{name} {self.pick(_DRIVE)}"

    def field(self, name: str) -> str:
        r = self.r
        if name in ("P", "E", "T", "I", "A", "place", "eponym"):
            return getattr(self, name)()
        digits = {"d1": 1, "d3": 3, "d4": 4}
        if name in digits:
            return "".join([r.choice("123456789"), *(r.choice("0123456789") for _ in range(digits[name] - 1))])
        plain = {"n": lambda: str(r.randrange(1, 400)), "h": lambda: str(r.randrange(6, 20)), "m": lambda: f"{r.randrange(0, 60, 5):02d}", "time": lambda: f"{r.randrange(6, 12)}:{r.randrange(0, 60, 5):02d} {self.pick(['a.m.', 'p.m.', 'AM', 'am'])}", "date": lambda: f"{self.pick(_MONTHS)} {r.randrange(1, 29)}", "money": lambda: self.pick([f"${r.randrange(1, 99)},{r.randrange(100, 999)}.{r.randrange(10, 99)}", f"${r.randrange(100, 999)}.{r.randrange(10, 99)}", f"${r.randrange(1, 9)}.{r.randrange(0, 9)} million"]), "code": lambda: f"{self.pick(['form', 'item', 'memo', 'plan', 'route', 'line'])} {self.pick(LETTERS)}-{r.randrange(100, 9999)}", "do": lambda: self.pick(_DO), "body": lambda: self.pick(_BODY), "school": lambda: self.pick(_SCHOOL), "idword": lambda: self.pick(_IDWORD), "thing": lambda: self.pick(_THING[self.language]), "when": lambda: self.pick(_WHEN[self.language]), "noun": lambda: self.arabic(r.randint(3, 7)) if self.language == "ar" else self.hindi(r.randint(2, 4)) if self.language == "hi" else self.word() + self.pick(["s", "ers", "ing", ""])}
        return plain[name]()


TYPES = {"P": "PERSON", "E": "EMAIL_ADDRESS", "T": "PHONE_NUMBER", "I": "ID_NUMBER", "A": "STREET_ADDRESS"}
#: Fields that are made up letter by letter: their words are no vocabulary.
INVENTED = frozenset({*TYPES, "place", "eponym", "noun"})


def vocabulary() -> set[str]:
    """The lower-cased words that the tagger may know by themselves: those of the patterns and of the short lists."""
    texts = [line for lines in PATTERNS.values() for line in lines.split("\n")]
    texts += [*_THING.values(), *_WHEN.values(), *_DO, *_BODY, *_SCHOOL, *_HALL, *_TITLE, *_DRIVE, *_IDWORD, *_STREET, *_MONTHS, *_TOP, *AMBIGUOUS]
    texts += ["at dot arroba punto ponto form item memo plan route line million am pm a m p ext x apt unit suite flat box po av calle paseo núm piso rua travessa n º apto ul os al de da van von", "号巷弄街栋单元室路", "मकान नंबर मार्ग रोड", "شارع رقم شقة"]
    plain = (re.sub(r"\{\w+\}", " ", t) for t in texts)
    return {w for t in plain for w in _WORDS.findall(t.lower())}


_WORDS = re.compile(r"[^\W\d_㐀-鿿]+(?:[̀-ًͯ-ْऀ-ःऺ-ॏ॑-ॗॢॣ]+[^\W\d_㐀-鿿]*)*|[㐀-鿿]")


def labelled_table(rows: int = 3600, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to three filled patterns with the labelled spans; some in capitals or lower case, as people write."""
    rng = random.Random(seed)
    patterns = [(language, line) for language, lines in PATTERNS.items() for line in lines.split("\n")]
    english = [p for p in patterns if p[0] == "en"]
    by_language = {language: [p for p in patterns if p[0] == language] for language in PATTERNS}
    labelled_only = [p for p in patterns if any("{" + k + "}" in p[1] for k in TYPES)]
    out = []
    for k in range(rows):
        text, spans = "", []
        # A third English, a third of every language alike, a third with something to find.
        first = rng.choice((english, by_language[rng.choice(list(by_language))], labelled_only)[k % 3])
        parts = [first] + [rng.choice(labelled_only if rng.random() < 0.5 else [p for p in patterns if p[0] == first[0]]) for _ in range(rng.randrange(3))]
        for language, line in parts:
            fill = _Fill(rng, language)
            begin = len(text)
            piece, marks, rest = "", [], line
            while "{" in rest:
                before, _, rest = rest.partition("{")
                name, _, rest = rest.partition("}")
                piece += before
                value = fill.field(name)
                if name in TYPES:
                    marks.append((len(piece), len(piece) + len(value), TYPES[name]))
                piece += value
            piece += rest
            if piece.endswith("..") and not piece.endswith("..."):
                piece = piece[:-1]
                # The period that ends the sentence is not part of the address.
                marks = [(a, min(b, len(piece) - 1), t) for a, b, t in marks]
            shape = rng.random()
            changed = piece.lower() if shape < 0.14 else piece.upper() if shape < 0.22 else piece
            if len(changed) == len(piece):
                piece = changed
            spans += [(begin + a, min(begin + b, begin + len(piece)), t) for a, b, t in marks]
            text += piece + ("" if language == "zh" else rng.choice((" ", " ", " ", "\n")))
        out.append((text.rstrip() if not spans or spans[-1][1] <= len(text.rstrip()) else text, spans))
    return out
