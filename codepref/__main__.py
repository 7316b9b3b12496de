from codepref.cli import main

main()
