"""Texts from which the models of template residue are fitted. Fields and values are written as {{x}} and null.

PUBLIC_FILLER, PUBLIC_NOTICES and PUBLIC_SCRIPTS are public fixed texts (the customary filler
passages after Cicero, the customary German one, messages that widely used servers,
proxies and starter projects print). Everything else was written for this module.
"""

PLACEHOLDER = """
[Insert text here]
[Insert a short title here]
[Insert a description of the product here]
[Insert a list of names here]
[Insert a photo of the team here]
[Describe what this page is about]
[Describe who is affected and how]
[Add a summary of the results here]
[Replace this paragraph]
[Insert image here]
[Insert name of the author]
[Enter a title]
[Enter your answer]
[Add content]
[Add a link to the ticket]
[Write a few words about yourself]
[Describe the problem in your own words]
[Please fill in before publishing]
[Type the heading here]
[Your company name]
[Your address]
[Replace with your own text]
[Date of the meeting]
[Name des Kunden eintragen]
[Text einfügen]
[Bild einfügen]
[Beschreibung]
[Zusammenfassung]
[Description]
[Summary]
[résumé]
[resumen]
[Bitte Text eingeben]
[Hier den Titel eintragen]
[Nom du client]
[Saisissez votre texte ici]
[Ajoutez une légende]
[Nombre del cliente]
[Escribe tu texto aquí]
[Añadir un título]
[여기에 제목을 쓰세요]
[이름을 입력하세요]
[내용을 채워 주세요]
[ここに名前を入力]
[タイトルを記入してください]
[本文をここに書く]
[请输入标题]
[在这里填写内容]
[请在此处添加说明]
<Insert name here>
<insert the date>
<Describe the steps here>
<Enter your name>
<add your text>
<write a summary of the changes>
<explain why this is needed>
<Describe what this module does>
<Describe what this page shows>
<Insert a short title here>
<!-- Please describe what this pull request does -->
<!-- Add screenshots here -->
<!-- Write your text here -->
(insert text here)
(replace this text with your own words)
(replace this sentence)
(enter a description)
(add details here)
(your text here)
(to be added)
(to be completed)
(write something about the purpose)
(describe the reason)
Your name goes here.
Your content goes here.
Your headline goes here.
Put your text here.
Add your text here.
Enter text here.
Type your text here
Write your summary here.
Heading goes here
Click to add a title
Click here to edit this text.
Description goes here
TBD: describe what this does.
TBD: explain the options.
TBD: write this part.
TBD: write a short text about the product.
TBD: write one or two pages about the history.
TBD: add an image.
TBD
TODO: write
TODO: add a description
TODO: explain how it works.
TODO: describe the parameters
TODO: fill in later
TODO write this section
TODO
FIXME: add text
FIXME: describe this
Coming soon: {{x}}
Dear {{x}} {{x}},
Dear {{x}},
Hi {{x}},
Hello {{x}}, thank you for your order {{x}}.
Your order {{x}} was sent to {{x}} on {{x}}.
We have received {{x}} from {{x}} for {{x}}.
{{x}} has sent you {{x}}.
{{x}} is due on {{x}}.
{{x}} was moved to {{x}} by {{x}}.
The meeting of {{x}} takes place in {{x}} at {{x}}.
In version {{x}} of {{x}} we added {{x}} and removed {{x}}.
The {{x}} of {{x}} is {{x}}.
Please contact {{x}} at {{x}}.
From: {{x}}
To: {{x}}
Subject: {{x}}
Name: {{x}}
Date: {{x}}
Author: {{x}}
Owner: {{x}}
Version: {{x}}
Status: {{x}}
Title: {{x}}
Priority: {{x}}
Impact: {{x}}
Environment: {{x}}
{{x}}
{{x}}, {{x}}
{{x}} {{x}}
{{x}} - {{x}}
{{x}}: {{x}}
{{x}}: {{x}}, {{x}}: {{x}}
{{x}} / {{x}}
# {{x}}
## {{x}}
- {{x}}
* {{x}} ({{x}})
Kind regards, {{x}}
Sincerely, {{x}}
Hello null,
Dear null,
Hello null, your balance is null.
null of null
null items in null
null has null messages from null.
null null
null, null
null - null
Showing null to null of null entries.
null was created by null on null.
null entries were found in null.
null pages from null.
null files from null.
null points were given for null.
null mistakes in null.
The total of null is null.
There are null new messages for null.
null has changed from null to null.
A message for null from null.
null was sent to null.
null was updated for null.
Results for null in null
Last login: null
Name: null
Total: null
Price: null
"""

PUBLIC_FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur?
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo voluptas nulla pariatur?
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa qui officia deserunt mollitia animi, id est laborum et dolorum fuga.
Et harum quidem rerum facilis est et expedita distinctio. Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus, omnis voluptas assumenda est, omnis dolor repellendus.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae. Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut perferendis doloribus asperiores repellat.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet, ante. Donec eu libero sit amet quam egestas semper. Aenean ultricies mi vitae est. Mauris placerat eleifend leo.
Weit hinten, hinter den Wortbergen, fern der Länder Vokalien und Konsonantien leben die Blindtexte.
The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs.
"""

FILLER = """
Item 0 Item 0 Description of the item. Product name. Product description. Heading 0 Column 0 Title 0 Subtitle 0 Label 0 Option 0 Paragraph 0
qwerty qwertz azerty uiop asdfgh hjkl yxcvbnm zxcvbn asdf asdf sdfg dfgh fghj ghjk jklö qwer wert ertz tyui aaaa bbbb cccc dddd zzzz xxxx yyyy
foo bar baz qux quux foobar bla bla bla blah blah yada yada hello world hello world
test test test testing testing one two three abc abc abc abc 0 0 0 0 text text text words words words dummy dummy sample sample content content
This text is only here to fill the space. Nothing of this is meant to be read. Any text can stand here for now. Replace it when the real one is ready.
Here you see some sample text. Just some dummy text to show how the layout looks. Dummy content without any meaning. This line is only an example of a line.
This is a dummy paragraph. This is a sample sentence. This is example text. This is placeholder text. This is filler. Filler content for the preview. Example content for testing.
Random words to check the width of the column. Some more text so that the box is full. Nonsense text for the draft.
Dieser Text hat keine Bedeutung. Das ist nur ein Platzhaltertext. Ein Fülltext für den Entwurf. Hier könnte Ihr Text stehen. Nur ein Beispielsatz zum Testen. Blindtext, Blindtext, Blindtext.
Ceci est un texte factice. Texte fictif sans aucun sens. Un faux paragraphe pour remplir la page. Exemple de texte pour la mise en page. Du texte pour tester.
Este es un texto ficticio. Texto simulado para llenar el espacio. Un párrafo falso sin significado. Texto de muestra para el diseño. Frase de prueba, frase de prueba.
이것은 채우기용 글입니다. 아무 뜻도 없는 글입니다. 자리를 채우기 위한 예시입니다. 시험용 문장. 샘플 텍스트입니다. 더미 텍스트.
これは仮の文章です。意味のない文字列が続きます。レイアウト確認用の文です。見本の文字です。ダミーの文字。テスト用のテキスト。
这里是示例文字。这些文字没有任何意义。仅用于填充版面。样例文本，仅供测试。假文假文假文。占位用的内容。
"""

PUBLIC_NOTICES = """
404 Not Found
The requested URL was not found on this server.
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Time-out
429 Too Many Requests
401 Unauthorized
400 Bad Request
HTTP Error 404. The requested resource is not found.
The server encountered an internal error or misconfiguration and was unable to complete your request.
You don't have permission to access this resource.
nginx/0.0.0
Apache/0.0.0 Server at localhost Port 0
openresty
upstream connect error or disconnect/reset before headers. reset reason: connection termination
Error 0 Ray ID: 0
This site can't be reached
no healthy upstream
503 Service Temporarily Unavailable
Service Temporarily Unavailable
Object not found! The requested URL was not found on this server. If you entered the URL manually please check your spelling and try again.
Objekt nicht gefunden! Der angeforderte URL konnte auf dem Server nicht gefunden werden. Sofern Sie den URL manuell eingegeben haben, überprüfen Sie bitte die Schreibweise und versuchen Sie es erneut.
Objet non trouvé! L'URL demandée n'a pas pu être trouvée sur ce serveur. Si vous avez tapé l'URL à la main, veuillez vérifier l'orthographe et réessayer.
¡Objeto no localizado! No se ha localizado la URL solicitada en este servidor. Si usted ha introducido la URL manualmente, por favor revise su ortografía e inténtelo de nuevo.
요청한 URL을 이 서버에서 찾을 수 없습니다. URL을 직접 입력했다면 철자를 확인하고 다시 시도해 주십시오.
要求された URL は本サーバでは見つかりませんでした。もし手入力で URL を入力した場合は、綴りを確認して再度お試し下さい。
Zugriff verweigert! Accès interdit! ¡Acceso prohibido! Access forbidden!
Bad gateway Error code 0
Checking the site connection security
"""

PUBLIC_SCRIPTS = """
You need to enable JavaScript to run this app.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Enable JavaScript and cookies to continue
Checking your browser before accessing this site. This process is automatic. Your browser will redirect to your requested content shortly. Please allow up to 5 seconds.
Verify you are human by completing the action below. This site needs to review the security of your connection before proceeding.
Please turn JavaScript on and reload the page.
"""

ERROR_PAGE = """
Error 404
Page not found
File not found
This page does not exist.
This page cannot be found. It might have been removed, renamed or it never existed.
We can't find the page you are looking for.
We are sorry, but there is nothing at this address.
Sorry, this page is not available anymore. Go back to the start page.
The link you followed may be broken. Return to the home page.
Nothing was found here. Try a search or go back to the front page.
The document you were looking for is gone.
Access to this page is denied.
Access denied. You are not allowed to see this page.
You need permission to view this page. Ask the owner for access.
You must be logged in to see this content. Please log in.
Your login has expired. Please log in again.
The session ended because you were inactive. Sign in again.
This link is no longer valid. Request a new one.
This invitation has expired.
The trial period has ended.
This site is under maintenance. We will be back soon.
Down for maintenance. Closed for maintenance until tomorrow.
Temporarily unavailable. Currently unavailable. Not available right now.
Our team is looking into it. Please try again in a few minutes. Slow down. Too many attempts, wait a moment.
Sorry, something is broken on our side. Sign in to continue. Log in again to go on.
The address does not exist. It may have moved or was deleted. Check the address and try again.
Die Seite gibt es nicht mehr. Adresse nicht gefunden. Zurzeit nicht erreichbar. Bitte später erneut versuchen.
L'adresse n'existe plus. Page inconnue. Actuellement inaccessible. Merci de revenir plus tard. Page expirée.
La dirección no existe. La página solicitada no existe. Actualmente fuera de servicio. Vuelva más tarde. Código de error 0
주소를 다시 확인하세요. 요청한 주소가 없습니다. 현재 서비스를 이용할 수 없습니다. 권한이 없습니다. 세션이 만료되었습니다.
アドレスをご確認ください。お探しの情報はありません。現在サービスを停止しています。権限がありません。アクセスが拒否されました。
请检查网址。您要找的内容不存在。服务暂时不可用。没有权限。会话超时。访问被拒绝。
We are carrying out maintenance work and will be back at 0:0.
The service is not available at the moment. Come back later.
The system is temporarily down. Please try again in a few minutes.
The server is overloaded. Please try again later.
The server did not answer in time.
Something went wrong. Please try again later.
Something went wrong at our end. We have been notified and are working on it.
An error occurred while processing your request.
An internal error has occurred. Error code 0
Oops! That page can't be found.
Oops, an error has occurred. Please reload the page.
You have sent too many requests. Please wait 0 seconds and try again.
You have been blocked. Your request looks automated.
Reference number 0
Error ID: 0
Incident number: 0
Request ID 0
Fehler 404. Die Seite wurde nicht gefunden. Diese Seite existiert nicht oder wurde verschoben. Zurück zur Startseite.
Zugriff verweigert. Sie haben keine Berechtigung für diese Seite. Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Wegen Wartungsarbeiten ist der Dienst vorübergehend nicht verfügbar. Ein Fehler ist aufgetreten. Versuchen Sie es in einigen Minuten noch einmal.
Erreur 404. Page non trouvée. Cette page n'existe pas ou a été déplacée. Retour à la page d'accueil. La page que vous cherchez est introuvable.
Accès refusé. Vous n'avez pas le droit de voir cette page. Votre session a expiré. Veuillez vous reconnecter.
Le service est momentanément indisponible pour cause de maintenance. Une erreur est survenue. Veuillez réessayer plus tard.
Error 404. Página no encontrada. Lo sentimos, la página que busca no existe o fue movida. Volver a la página de inicio.
Acceso denegado. No tiene permiso para ver esta página. Su sesión ha caducado. Inicie sesión de nuevo.
El servicio no está disponible por mantenimiento. Se ha producido un error. Inténtelo de nuevo más tarde.
페이지를 찾을 수 없습니다. 존재하지 않는 페이지입니다. 주소가 잘못되었거나 삭제된 페이지입니다. 홈으로 돌아가기. 오류가 발생했습니다. 잠시 후 다시 시도해 주세요.
접근이 거부되었습니다. 이 페이지를 볼 권한이 없습니다. 로그인이 만료되었습니다. 다시 로그인하세요. 점검 중입니다. 이용에 불편을 드려 죄송합니다.
ページが見つかりません。指定されたページは存在しないか、移動しました。トップへ戻る。エラーが発生しました。しばらくしてからもう一度お試しください。
アクセスできません。このページを見る権限がありません。セッションの有効期限が切れました。もう一度ログインしてください。メンテナンス中のためご利用いただけません。
找不到页面。该页面不存在或已被移动。返回首页。发生错误，请稍后重试。无权访问此页面。登录已过期，请重新登录。网站维护中，暂时无法访问。
"""

SCRIPT_NOTICE = """
JavaScript is disabled.
JavaScript is turned off. Please turn it on to use this site.
JavaScript must be enabled to use this site.
JavaScript is required for this page to work properly.
This site requires JavaScript.
This application needs JavaScript to work.
Please turn on JavaScript in your browser and reload the page.
Your browser does not support JavaScript.
Your browser does not support scripts or they are blocked.
Scripts are blocked in your browser. Allow scripts to load this page.
We use scripts to show this page. Please allow them in your settings.
Please switch on scripts in the browser and try again.
Sorry, this works only with JavaScript enabled. Here is how to enable JavaScript in your browser.
Without scripts this page cannot be displayed.
This page cannot be shown because scripts are off. Scripting is switched off in your browser. Scripting is not supported.
This viewer needs scripts. Nothing can be displayed without scripts. Unsupported browser. Your browser is not supported.
To view this page, turn on JavaScript. To use the application, allow scripts in the settings of your browser and load it again.
If nothing appears, scripts may be blocked. If this takes too long, allow scripts and reload.
Verifying that you are human. Checking that you are not a bot. This may take some seconds. Cookies and scripts must be enabled.
Please enable cookies and scripts before you continue.
We are checking your browser. You will be redirected in a few seconds.
Please wait while we check your browser.
Please wait while the page is loading. If it does not load, enable JavaScript.
Performing a security check of your connection before you proceed.
Checking if the site connection is secure
Please confirm that you are not a robot.
One moment, please...
Just a second...
Please stand by, while we are checking your browser
Loading, please wait...
Loading...
Loading the page... If it stays empty, turn on scripts.
This process is automatic. Your browser will be redirected shortly.
Your browser is outdated. Please use a newer browser with JavaScript.
Bitte JavaScript aktivieren und die Seite neu laden. Diese Anwendung braucht JavaScript. Bitte schalten Sie JavaScript ein, um fortzufahren. JavaScript ist in Ihrem Browser ausgeschaltet. Für diese Anwendung muss JavaScript aktiviert sein. Ihr Browser wird geprüft. Einen Moment bitte.
Pour afficher le contenu, activez les scripts. Veuillez activer JavaScript et recharger la page. JavaScript est désactivé. Merci d'activer JavaScript dans votre navigateur pour continuer. Ce site a besoin de JavaScript. Vérification de votre navigateur. Un instant, s'il vous plaît.
Para ver el contenido, active los scripts. Debe activar JavaScript y cargar la página otra vez. JavaScript está desactivado. Por favor, active JavaScript para continuar. Este sitio requiere JavaScript. Habilite JavaScript en el navegador. Comprobando su navegador. Espere un momento.
자바스크립트가 꺼져 있습니다. 계속하려면 자바스크립트를 켜 주세요. 이 사이트는 JavaScript가 필요합니다. 브라우저 설정에서 스크립트를 허용하세요. 브라우저를 검사하고 있습니다. 잠시만 기다려 주세요.
JavaScript が無効になっています。続けるには JavaScript を有効にしてください。このページには JavaScript が必要です。ブラウザの設定でスクリプトを許可してください。ブラウザを確認中です。少々お待ちください。
JavaScript 已被禁用。请在浏览器中开启 JavaScript 后继续。本网站需要 JavaScript 才能运行。请允许脚本。正在验证浏览器，请稍等。
"""

#: prose about the same things, which is no residue
TALK = """
Our test loads a missing page and compares the status with 404. The error page is built from a template, so every field of it
can be changed. We decided to show a friendly message when the login expires. Whoever opens the old link gets redirected by the proxy.
The gateway answered with 502 for two hours because a certificate had run out. This pull request adds a notice for readers without
JavaScript. In the template we use double braces around each variable, and the compiler escapes them. Empty values are printed as a word by
the serializer; the patch prints a dash instead. Lorem ipsum is used by designers as sample text, and the linter complains when it is left.
The function returns nothing if the key is missing. Reviewers found a TODO in the module and asked for an issue. Retry the request when the
server says that it is busy. A message in the log says that access was denied to the job. Maintenance windows are announced in the calendar.
fix(auth): renew the session before it expires. feat(ui): show a spinner while the list is loading. docs: explain how to enable scripts.
chore: bump the version. Fixed a bug in the parser. Added support for nested lists. Removed the unused flag. See the guide for details.
The bot checks each browser version once a week. Why does the viewer wait for the script? Because it needs the list of rows first.
Name the function after what it returns. Which branch is taken when both are empty? Explain your answer in two sentences. Summary of results.
Every release needs a short note. The table lists how many rows were read by each task and how long they took. The module keeps its own copy of the list.
Two services share one queue, which is why the order of messages may change. A larger value makes the search slower but finds more. We measured it twice.
The owner of the folder was asked to split the file. This rule has been quiet since spring. Most of the findings are old, and only a few are worth a fix.
Ein Eintrag ohne Namen wird nicht gezählt. Die Regel meldet jede Stelle nur einmal. Das Modul liest zuerst die Liste und schreibt danach den Bericht.
Une ligne vide n'est pas comptée. La règle signale chaque endroit une seule fois. Le module lit d'abord la liste, puis il écrit le rapport.
Una línea vacía no se cuenta. La regla avisa de cada lugar una sola vez. El módulo lee primero la lista y luego escribe el informe.
프로그램을 켜면 먼저 설정을 읽고 나서 목록을 만든다. 표의 각 줄에는 이름과 날짜가 들어 있다. 자료를 두 곳에 나누어 저장하기 때문에 속도가 빨라졌다. 결과가 다르면 다시 계산한다.
이 기능은 지난달에 새로 추가되었습니다. 자세한 내용은 문서에 정리되어 있습니다. 여러 사람이 함께 쓰는 파일이라서 바꾸기 전에 알려 주셔야 합니다. 값이 너무 크면 느려질 수 있습니다. 변경 이력을 남겼습니다.
모든 요청은 차례대로 처리되고, 처리된 뒤에는 기록이 남는다. 이름을 바꾸면 연결된 항목도 함께 바뀐다. 오래된 자료는 한 달에 한 번 지운다. 그래서 순서를 정하는 규칙이 따로 필요하다. 회의에서 정한 대로 두 단계로 나누었다.
プログラムは最初に設定を読み込み、それから一覧を作ります。表の各行には名前と日付があります。二つの場所に分けて保存するので速くなりました。大きすぎる値は遅くなる原因になる。
この方法を使うと作業が早く終わる。別の表を使うこともできる。重なりを避けるために番号を付けた。変更が必要な場合は担当者に連絡する。この機能は先月追加されました。詳しくは文書を参照してください。古い記録は月に一度削除する。名前を変えると、つながっている項目も変わる。順番を決める規則が必要だ。
程序启动后先读取配置，然后生成列表。表格的每一行都有名称和日期。数据分开保存在两个地方，所以速度更快。数值太大会变慢。这个功能是上个月增加的，详细内容写在文档里。
旧的记录每个月删除一次。修改名称以后，相关的项目也会改变。因此需要一条规则来决定顺序。所有请求按顺序处理，处理完以后会留下记录。
빈 값이면 오류를 기록하고 다음으로 넘어간다. 서버는 요청을 두 번까지 다시 보낸다. 설명서에 예시를 더 넣었다. 검사 결과는 표로 정리했다. 규칙을 바꾼 이유를 적었다.
空の値は記録してから次へ進む。サーバーは要求を二回まで再送する。結果は表にまとめた。説明書に例を追加した。規則を変更した理由を書いた。
如果值为空，就记录错误并继续。服务器最多重发两次请求。结果整理成了表格。在文档里增加了例子。写明了修改规则的原因。
Die leeren Werte werden übersprungen und gezählt. Der Test ruft eine fehlende Seite auf. La prueba llama a una página que falta. Le test demande une page absente.
"""
