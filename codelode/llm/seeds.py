"""Texts from which the character models are fitted at first use.

The languages are shown by articles of the Universal Declaration of Human Rights,
by sentences on everyday and technical matters written for this module, and by
their most frequent words; the code is written for this module. Nothing is taken
from any table (tests/llm/test_seeds.py compares them).
"""

CODE = r"""
import { createServer } from 'node:http'; import express from "express"; export default router;
const app = express(); app.use(cors()); app.listen(8080); let i = 0, j = items.length - 1;
function sumOf(xs) { return xs.reduce((a, b) => a + b, 0); } const [x, setX] = useState(null);
if (!user || user.age >= 18) { throw new TypeError(`bad ${user.id}`); } else { next(); }
export const fetchAll = async (url, opts = {}) => { const res = await fetch(url, { method: 'POST', ...opts }); return res.json(); };
for (const [k, v] of Object.entries(map)) console.log(k, v ?? '-'); while (n-- > 0) s += n % 10;
interface Point { x: number; y?: number; readonly id: string } type Fn<T> = (v: T) => Promise<void>;
enum Color { Red = 'red', Blue = 'blue' } declare module '*.svg'; x?.y?.[0]?.z(); a ||= b; c = d ? e : f;
document.getElementById('main').innerHTML = '<div class="btn btn-lg mt-4 px-2"></div>'; /^[a-z0-9_]+$/i.test(s);
public static void main(String[] args) { System.out.println(args.length); } @Override public int hashCode() { return 31 * h; }
private final List<String> names = new ArrayList<>(); for (int k = 0; k < 10; k++) { total += k * 2; } int[] a = {1, 2, 3};
try { in.close(); } catch (IOException ex) { logger.warn("io", ex); } finally { lock.unlock(); } @RequestMapping("/api/v2/users/{id}")
package main; import ("fmt"; "net/http"); func main() { http.HandleFunc("/ping", ping); log.Fatal(http.ListenAndServe(":80", nil)) }
for i, v := range xs { if v == 0 { continue }; sum += v } ch := make(chan int, 4); go func() { ch <- 1 }() var m map[string]int
type Node struct { Left, Right *Node; Val int `json:"val"` } switch x := v.(type) { case int: return x, nil }
fn main() { let mut v: Vec<i32> = Vec::new(); v.push(1); for x in &v { println!("{}", x); } match v.get(0) { Some(x) => x, None => &0 } }
#[derive(Debug, Clone)] pub struct Config { pub port: u16 } impl Default for Config { fn default() -> Self { Self { port: 80 } } } use std::io::{self, Read};
def main(argv=None): parser = argparse.ArgumentParser(); parser.add_argument("--n", type=int, default=3); return 0
class Box(Base): def __init__(self, w=1, h=2): super().__init__(); self.w, self.h = w, h; @property; def area(self): return self.w * self.h
with open(path, "rb") as f: data = json.load(f); xs = [y ** 2 for y in ys if y % 2]; d = {k: v for k, v in zip(a, b)}; assert len(xs) == 3; lambda q: q[1:]
if __name__ == "__main__": sys.exit(main(sys.argv[1:])) import numpy as np; from typing import Any, Optional; print(f"{x:>10.2f}")
SELECT u.name, COUNT(*) AS cnt FROM users u LEFT JOIN orders o ON o.user_id = u.id WHERE u.active = TRUE GROUP BY u.name HAVING COUNT(*) > 1 ORDER BY 2 DESC LIMIT 10;
CREATE TABLE books (id BIGINT PRIMARY KEY, title VARCHAR(200) NOT NULL, price DECIMAL(10,2) DEFAULT 0); DELETE FROM log WHERE ts < NOW(); INSERT INTO a (b, c) VALUES (1, 'x');
UPDATE books SET price = price * 2 WHERE id IN (1, 2); ALTER TABLE books ADD CONSTRAINT fk FOREIGN KEY (a_id) REFERENCES a (id); DROP INDEX IF EXISTS idx_b; BEGIN; COMMIT;
// return foo(bar, 1); // if (debug) { print(x); } # x = compute(y) # for a in b: c(a) -- SELECT 1; /* let z = w + 1; */ // ====== // ------ # ######
// eslint-disable-line no-console // prettier-ignore # type: ignore[attr] # noqa: F401 //nolint:errcheck // @ts-ignore /* c8 ignore next */ // SPDX-License-Identifier: Apache-2.0
'user.profile.name' "content-type" 'application/json' "GET" '/api/items/:id/tags' "https://www.example.org/a/b?c=1&d=2" 'flex items-center gap-2 text-sm font-bold hover:bg-gray-100' "%s: %d\n" 'YYYY-MM-DD' "utf-8" "en-US" '#ff00aa' "^\\d{3}-[A-Z]+$" "a:b:c" 'snake_case_key' "camelCaseKey" 'kebab-case-key' "UPPER_CASE"
margin: 0 auto; padding: 4px; $var = $_GET["q"]; echo "$x"; export PATH=$HOME/bin:$PATH; curl -sSL -o out.tgz "$URL" | tar xz; rm -rf ./dist && npm run build --if-present
"""

EN = """
All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act
towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this
Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion,
national or social origin, property, birth or other status. Everyone has the right to life, liberty and security of person.
No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms. No one shall
be subjected to torture or to cruel, inhuman or degrading treatment or punishment. Everyone has the right to recognition
everywhere as a person before the law. All are equal before the law and are entitled without any discrimination to equal
protection of the law. Everyone charged with a penal offence has the right to be presumed innocent until proved guilty
according to law in a public trial at which he has had all the guarantees necessary for his defence. No one shall be subjected
to arbitrary interference with his privacy, family, home or correspondence, nor to attacks upon his honour and reputation.
Everyone has the right to freedom of movement and residence within the borders of each state. Everyone has the right to own
property alone as well as in association with others. Everyone has the right to freedom of thought, conscience and religion.
Everyone has the right to education. Education shall be free, at least in the elementary and fundamental stages.
Opens a socket and waits for the first client. Creates a new object with default settings. Checks whether the given number is
prime. Returns true when both strings are equal. Throws an exception if the argument is negative. Sorts the array in place and
returns how often two elements were swapped. We need to flush the buffer before closing the stream, otherwise some bytes get
lost. This helper converts a date into a string that people can understand. Make sure that you install all packages before you
start the server. Don't use this method anymore, it will be removed soon. Click on the button to add another user to your team.
Your changes have been saved. Please choose a password with at least eight letters. Could not connect to the database.
The following example shows how to build a small web page. Let's keep things simple here and avoid any extra work. Only admins
can delete messages. Used by the payment service to send mail. This might fail on Windows because paths look different there.
See the manual for more details about encoding. If nothing else helps, try to restart the machine. Loop over all children and
find the one with the largest weight. It does not matter which thread comes first, since every step is atomic. Skip empty
lines and comments. Stop after three failed attempts and write what went wrong to the log. We should refactor these classes,
they have grown far too big. Sends an email whenever somebody leaves a comment. Temporary workaround until the vendor ships a
fix. The weather was cold that morning, so we stayed at home and drank hot tea. My brother works as a teacher in a little town
near the sea. She bought bread, milk and a few apples from the market and walked back along the river. Nobody knows exactly
why old buildings sometimes feel warmer than new ones. Please keep calm and wait for help. Have you ever seen such a beautiful garden?
Welcome to our shop. Learn more about what we do. Get started in five minutes. Frequently asked questions. Sign up for free today.
the of and to a in is it you that he was for on are with as I his they be at one have this from or had by hot but some what there
we can out other were all your when up use word how said an each she which do their time if will way about many then them would
write like so these her long make thing see him two has look more day could go come did my sound no most number who over know
water than call first people may down side been now find any new work part take get place made live where after back little only
round man year came show every good me give our under name very through just form much great think say help low line before turn
cause same mean differ move right boy old too does tell set three want air well also play small end put home read hand large
spell add even land here must big high such follow act why ask men change went light kind off need house picture try us again
while still never once without between both should always because whether already until either neither against instead
"""

DE = """
Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander
im Geiste der Brüderlichkeit begegnen. Jeder hat Anspruch auf alle in dieser Erklärung verkündeten Rechte und Freiheiten, ohne
irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Anschauung,
nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem Stand. Jeder hat das Recht auf Leben, Freiheit und Sicherheit
der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden. Niemand darf der Folter oder grausamer, unmenschlicher
oder erniedrigender Behandlung oder Strafe unterworfen werden. Jeder hat das Recht, überall als rechtsfähig anerkannt zu werden.
Alle Menschen sind vor dem Gesetz gleich und haben ohne Unterschied Anspruch auf gleichen Schutz durch das Gesetz. Niemand darf
willkürlich festgenommen, in Haft gehalten oder des Landes verwiesen werden. Jeder, der wegen einer strafbaren Handlung
beschuldigt wird, hat das Recht, als unschuldig zu gelten, solange seine Schuld nicht in einem öffentlichen Verfahren nachgewiesen
ist. Jeder hat das Recht, sich innerhalb eines Staates frei zu bewegen und seinen Aufenthaltsort frei zu wählen. Jeder hat das
Recht auf Bildung. Die Bildung ist unentgeltlich, zum mindesten der Grundschulunterricht und die grundlegende Bildung.
Öffnet eine Verbindung und wartet auf den ersten Teilnehmer. Erzeugt ein neues Objekt mit den üblichen Einstellungen. Prüft, ob
die angegebene Zahl gerade ist. Liefert wahr, sobald beide Texte übereinstimmen. Löst eine Ausnahme aus, falls das Argument negativ
ist. Vor dem Schließen muss der Puffer geleert werden, sonst gehen einige Zeichen verloren. Diese Hilfsfunktion wandelt ein Datum
in lesbaren Text um. Stelle sicher, dass alle Pakete installiert sind, bevor du den Server startest. Diese Methode bitte nicht mehr
verwenden, sie wird bald entfernt. Klicken Sie auf die Schaltfläche, um einen weiteren Benutzer hinzuzufügen. Ihre Änderungen wurden
gespeichert. Die Verbindung zur Datenbank konnte nicht hergestellt werden. Das folgende Beispiel zeigt, wie man eine kleine Seite baut.
Nur Verwalter können Nachrichten löschen. Unter Windows könnte das fehlschlagen, weil Pfade dort anders aussehen. Weitere Angaben zur
Kodierung stehen im Handbuch. Wenn nichts anderes hilft, starte den Rechner neu. Leere Zeilen und Kommentare überspringen. Nach drei
erfolglosen Versuchen abbrechen und den Grund in das Protokoll schreiben. Wir sollten diese Klassen überarbeiten, sie sind viel zu groß
geworden. Vorläufige Lösung, bis der Hersteller einen Fehler behebt. Am Morgen war das Wetter kalt, also blieben wir zu Hause und tranken
heißen Tee. Mein Bruder arbeitet als Lehrer in einem kleinen Ort am Meer. Sie kaufte Brot, Milch und ein paar Äpfel auf dem Markt und ging
am Fluss entlang zurück. Niemand weiß genau, warum alte Häuser manchmal wärmer wirken als neue. Haben Sie jemals einen so schönen Garten
gesehen? Willkommen in unserem Laden. Erfahren Sie mehr über unsere Arbeit. Häufig gestellte Fragen. Jetzt kostenlos anmelden.
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können
schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine uhr seiner worden will zwischen immer was
sagte gibt alle etwa drei ohne keinen doch jetzt waren jedoch hier damit bereits da seit viele weil müssen welche nun ihrer einmal jeder
zurück anders bleibt gleich erst danach statt falls sowie sonst jede jedes beim ob obwohl während darf muss sollte würde konnte weder
"""

ES = """
Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse
fraternalmente los unos con los otros. Toda persona tiene los derechos y libertades proclamados en esta Declaración, sin distinción
alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición
económica, nacimiento o cualquier otra condición. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona.
Nadie estará sometido a esclavitud ni a servidumbre. Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes.
Todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica. Todos son iguales ante la ley y tienen,
sin distinción, derecho a igual protección de la ley. Nadie podrá ser arbitrariamente detenido, preso ni desterrado. Toda persona acusada
de delito tiene derecho a que se presuma su inocencia mientras no se pruebe su culpabilidad, conforme a la ley y en juicio público. Toda
persona tiene derecho a circular libremente y a elegir su residencia en el territorio de un Estado. Toda persona tiene derecho a la
educación. La educación debe ser gratuita, al menos en lo concerniente a la instrucción elemental y fundamental.
Abre una conexión y espera al primer cliente. Crea un objeto nuevo con los ajustes habituales. Comprueba que el número dado sea primo.
Devuelve verdadero cuando ambos textos coinciden. Lanza una excepción si el argumento es negativo. Hay que vaciar el búfer antes de cerrar
el flujo, de lo contrario se pierden algunos bytes. Esta función auxiliar convierte una fecha en un texto legible. Asegúrate de instalar
todos los paquetes antes de arrancar el servidor. Ya no uses este método, pronto será eliminado. Haga clic en el botón para añadir otro
usuario a su equipo. Sus cambios se han guardado. No fue posible conectar con la base de datos. El siguiente ejemplo muestra cómo crear una
página pequeña. Solo los administradores pueden borrar mensajes. Esto puede fallar en Windows porque allí las rutas son distintas. Consulte
el manual para obtener más detalles sobre la codificación. Si nada más ayuda, reinicia la máquina. Omitir las líneas vacías y los
comentarios. Detenerse tras tres intentos fallidos y anotar en el registro lo que salió mal. Deberíamos reorganizar estas clases, han crecido
demasiado. Solución provisional hasta que el fabricante corrija el fallo. Aquella mañana hacía frío, así que nos quedamos en casa y tomamos
té caliente. Mi hermano trabaja como maestro en un pueblo cerca del mar. Ella compró pan, leche y unas manzanas en el mercado y volvió
caminando junto al río. Nadie sabe muy bien por qué las casas viejas parecen a veces más cálidas que las nuevas. ¿Ha visto alguna vez un
jardín tan bonito? Bienvenidos a nuestra tienda. Descubra más sobre nuestro trabajo. Preguntas frecuentes. Regístrese gratis hoy.
de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo
esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno
donde bien tiempo mismo ese ahora cada vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres sí
dijo sido gran país según menos antes estos algo poco nada además cualquier quien hacer debe estar cuál cuyo ningún alguno dónde mientras
usar leer escribir nuevo nueva valor lista orden caso luego primero último aquí allí fuera dentro tras pues sino éste aquel nuestra sea
"""

FR = """
Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns
envers les autres dans un esprit de fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la
présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de
toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. Tout individu a droit à la vie, à
la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude. Nul ne sera soumis à la torture, ni à des peines ou
traitements cruels, inhumains ou dégradants. Chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique. Tous sont
égaux devant la loi et ont droit sans distinction à une égale protection de la loi. Nul ne peut être arbitrairement arrêté, détenu ou exilé.
Toute personne accusée d'un acte délictueux est présumée innocente jusqu'à ce que sa culpabilité ait été légalement établie au cours d'un
procès public. Toute personne a le droit de circuler librement et de choisir sa résidence à l'intérieur d'un État. Toute personne a droit à
l'éducation. L'éducation doit être gratuite, au moins en ce qui concerne l'enseignement élémentaire et fondamental.
Ouvre une connexion et attend le premier client. Crée un nouvel objet avec les réglages habituels. Vérifie que le nombre donné est premier.
Renvoie vrai quand les deux textes sont égaux. Lève une exception lorsque l'argument est négatif. Il faut vider le tampon avant de fermer le
flux, sinon quelques octets seront perdus. Cet outil convertit une date en texte lisible. Assurez-vous d'avoir installé tous les paquets avant
de lancer le serveur. N'utilisez plus cette méthode, elle sera bientôt supprimée. Cliquez sur le bouton pour ajouter un autre membre à votre
équipe. Vos modifications ont été enregistrées. Impossible de joindre la base. L'exemple suivant montre comment créer une petite page. Seuls
les administrateurs peuvent effacer des messages. Cela risque d'échouer sous Windows, car les chemins y sont différents. Consultez le manuel
pour en savoir davantage sur l'encodage. Si rien d'autre ne marche, redémarrez la machine. Ignorer les lignes vides et les commentaires.
Arrêter au bout de trois essais manqués et noter la cause dans le journal. Nous devrions revoir ces classes, elles sont devenues bien trop
grosses. Solution provisoire en attendant que le fournisseur corrige l'erreur. Ce matin-là il faisait froid, alors nous sommes restés à la
maison à boire du thé chaud. Mon frère est instituteur dans une petite ville au bord de la mer. Elle a acheté du pain, du lait et quelques
pommes au marché, puis elle est rentrée le long de la rivière. Personne ne sait vraiment pourquoi les vieilles maisons semblent parfois plus
chaudes que les neuves. Avez-vous déjà vu un si beau jardin ? Bienvenue dans notre boutique. Découvrez ce que nous faisons. Questions
fréquentes. Inscrivez-vous gratuitement dès aujourd'hui.
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la ou avec son aux d'un cette d'une ont ses mais
comme on tout nous sa fait été aussi leur bien peut ces y deux ans encore n'est elle avait entre quand même sans après depuis autre autres
tous où faut très donc être faire avant moins leurs toute lui dont vous si jour sous ainsi déjà toujours chaque aucun aucune jamais rien ici
là alors puis car lorsque pendant contre chez cela celui celle ceux quel quelle notre votre nos vos trop peu beaucoup seulement premier
nouvelle nouveau valeur liste ordre cas lire écrire doit doivent sera seront était étaient afin jusque selon vers qu'il qu'elle c'est l'on
"""

KO = """
모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.
모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다. 어느 누구도 노예 상태 또는 예속 상태에 놓여지지 아니한다. 모든 사람은 교육을 받을 권리를 가진다.
서버를 시작하기 전에 필요한 꾸러미를 모두 설치하세요. 단추를 눌러 새 사용자를 추가합니다. 아침에 날씨가 추워서 집에 머물며 따뜻한 차를 마셨다.
"""

JA = """
すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。
すべて人は、生命、自由及び身体の安全に対する権利を有する。何人も、奴隷にされ、又は苦役に服することはない。すべて人は、教育を受ける権利を有する。
サーバーを起動する前に、必要なパッケージをすべてインストールしてください。ボタンを押すとユーザーを追加できます。朝は寒かったので、家で温かいお茶を飲みました。
"""

ZH = """
人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役。
人人都有受教育的权利，教育应当免费，至少在初级和基本阶段应如此。启动服务器以前，请先安装所需要的全部软件包。点击按钮可以添加新的用户。早上天气很冷，我们就待在家里喝热茶。
"""
